import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from paperloom.llm import queries
from paperloom.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def brute(rows, least_count=3, slip=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least_count}
    form, counts = {}, Counter()
    for w in n:
        others = [x for x in n if near(w, x)]
        counts[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], n[w], counts[w], n.get(form[w])) for w in n}


def rows_of(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def drawn(seed, words=120):
    """Documents of words that are variants of each other, with many of each."""
    rng = random.Random(seed)
    letters = "abcdeéÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(8)]
    made = set(stems)
    while len(made) < words:
        w = rng.choice(sorted(made))
        k = rng.randrange(len(w))
        made.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w.upper()]))
    made = sorted(made)
    weights = [2 ** rng.randint(0, 7) for _ in made]
    return [(i, " ".join(rng.choices(made, weights, k=60))) for i in range(40)]


@pytest.mark.parametrize("max_bucket", [256, 4, 1])
def test_equals_brute_force(spark, max_bucket):
    rows = drawn(11)
    got = rows_of(S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), max_bucket=max_bucket, slip=5))
    assert len(got) == len(set(got)) and set(got) == brute(rows, slip=5)


def test_query_equals_brute_force_on_a_table(spark, tmp_path):
    rows = drawn(3, 60) + [(100, "Whole wholes whOLE wholé whole whole WHOLES wholes straße strasse straße straße strase strase strase")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op11_spelling(spark, str(tmp_path)))
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_masks_of_near_words_share_a_band_and_a_half(spark):
    words = sorted({w for _, text in drawn(7, 80) for w in text.lower().split()})
    masks = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", S.parity_mask(S.F.col("word"))).collect()}
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            flipped = masks[a] ^ masks[b]
            assert flipped.bit_count() <= 2
            assert any(not flipped >> k * S.BAND_BITS & (1 << S.BAND_BITS) - 1 for k in range(S.BANDS))


def test_pairs_are_found_once_on_both_ways(spark):
    rng = random.Random(1)
    words = sorted({"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 4))) for _ in range(150)} | {"aaaaa", "aaaaaa", "aaaab"})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p)}
    for pairs in (S.near_pairs(df), S.near_pairs(df, 8), S.deletion_pairs(df)):
        got = [tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()]
        assert len(got) == len(want) and set(got) == want


def test_long_ways_lead_to_the_last(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("side", "w5"), ("other", "end")]
    got = {r["word"]: r["root"] for r in S.last_forms(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{k}": "w37" for k in range(37)} | {"side": "w37", "other": "end"}
    assert S.last_forms(spark.createDataFrame([], "word string, form string")).count() == 0


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] * 3
    assert set(rows_of(S.spelling_variants(odd.union(odd).union(odd)))) == brute(rows)
    assert S.spelling_variants(none).count() == 0
    long = spark.createDataFrame([(1, "abcde" * 40_000 + " " + "x" * 70_000)] * 3, "doc_id long, text string")
    assert sorted(len(r[0]) for r in rows_of(S.spelling_variants(long, slip=10**9))) == [70_000, 200_000]
