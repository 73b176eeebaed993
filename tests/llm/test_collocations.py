import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import collocations as C
from paperloom.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, *p), a in f.items():
        if len(p) < 2:
            continue
        if any(q[0] == lang and len(q) - 1 > len(p) and 100 * c >= cover * a and any(list(q[i : i + len(p)]) == p for i in range(1, len(q) - len(p) + 1)) for q, c in f.items()):
            continue
        cuts = [(2000000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, rank, p.decode(), -a, le, r, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, le, r) in enumerate(sorted(x)[:top], 1)}


def rows_of(df):
    return [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()]


def drawn(seed, docs=60):
    rng = random.Random(seed)
    common, rare = ["the", "Of", "and", "é", "zz"], [f"r{k}" for k in range(60)]
    fixed = ["the same passage again", "New York", "of the", "a b c d e f", "one  two\tthree four"]
    make = lambda: "".join(rng.choice([rng.choice(common), rng.choice(rare), rng.choice(fixed)]) + rng.choice([" ", " ", " ", "  ", ". ", ", ", "\n", "\t"]) for _ in range(120))
    return [(rng.choice(["en", "fr", None]), make()) for _ in range(docs)]


SCHEMA = "lang string, text string"


@pytest.mark.parametrize(("heavy", "top"), [(1 / 2000, 2000), (0.02, 5), (1e-9, 2000), (2.0, 2000)])
def test_equals_brute_force(spark, heavy, top):
    rows = drawn(4)
    got = rows_of(C.collocations(spark.createDataFrame(rows, SCHEMA), top=top, heavy_share=heavy))
    want = brute(rows, top=top)
    assert len(got) == len(want) > 4 and set(got) == want


def test_query_equals_brute_force_on_a_table(spark, tmp_path):
    rows = drawn(9, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op12_collocations(spark, str(tmp_path)))
    assert set(got) == brute(rows) and len(got) == len(brute(rows))


def test_steps_change_no_pointer(monkeypatch):
    bits = b"\xff" * (1 << C.MAP_BITS - 3)
    batch = pa.record_batch([pa.array([a or "und" for a, _ in drawn(2)]), pa.array([t for _, t in drawn(2)])], names=["lang", "text"])
    whole = np.concatenate(list(C.projected(batch, 0, bits, {})))
    monkeypatch.setattr(C, "STEP_WORDS", 17)
    monkeypatch.setattr(C, "MAX_CACHE", 3)
    assert (np.concatenate(list(C.projected(batch, 0, bits, {}))) == whole).all()


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_runs_are_grown_whole(size):
    rng = np.random.default_rng(1)
    w = rng.integers(1, 4, (5000, 4))
    w[rng.random(5000) < 0.2, 2:] = 0
    w[rng.random(5000) < 0.2, 3] = 0
    s = w[:, 0] % 2 * 10 + w[:, 1] % 3  # two pairs share each
    order = np.argsort(s, kind="stable")
    w, s, ones, depth = w[order], s[order], np.ones(5000, np.int64), np.full(5000, 2)
    want = Counter(tuple(int(v) if j < k else 0 for j, v in enumerate(r)) for r in w for k in (2, 3, 4) if r[k - 1])
    blocks = ((s[i : i + 7], w[i : i + 7], ones[i : i + 7], depth[i : i + 7]) for i in range(0, 5000, 7))
    got = [(tuple(map(int, r)), int(c)) for whole in C.whole_runs(blocks, size) for a, b in C.grown(*whole, np.zeros(0, np.uint64), 40) for r, c in zip(a, b)]
    assert len(got) == len(dict(got)) and dict(got) == {p: c for p, c in want.items() if c >= 40}
    assert list(C.whole_runs(iter([]))) == []


def test_equal_pointers_of_heavy_prefixes_are_one_row():
    w = np.array([[1, 2, 3, 4]] * 50 + [[1, 2, 5, 6]] * 3)
    heavy = np.sort(C.prefix_hashes(w)[0, :3])
    rows, depth, n = C.dealt(w, heavy)
    assert sorted(zip(map(int, n), map(int, depth))) == [(1, 3)] * 3 + [(50, 4)]


def test_large_counts_stay_exact(spark):
    rows = [("en", "x y. x. " * 50), ("en", "y " * 3)]
    assert rows_of(C.collocations(spark.createDataFrame(rows, SCHEMA))) == [("en", 1, "x y", 50, 100, 53, 153, 653594)]


def test_odd_rows(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert set(rows_of(C.collocations(odd))) == brute(rows)
    assert C.collocations(none).count() == 0
