import functools
import math
import random
import re

import numpy as np
import zstandard

from paperloom.llm.quality import ABOVE, BELOW, GREATEST, LEAST, LEAST_RATIOS, Measure, quality_rules, repeated_words

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_counts_against_brute_force(odd, none):
    rng = random.Random(1)
    texts = [None, "", "a\nb\n\na\na ", "é x y z é x y z", "a " * 60]
    texts += ["".join(rng.choice("ab#|\n \t\x0b\x1fÉ") for _ in range(rng.randrange(400))) for _ in range(200)]
    measure = Measure()
    for t in texts:
        r = measure.row(t)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(t), repr(t)
    got = {(r["doc_id"], r["n_words"], r["base_failed"]) for r in quality_rules(odd).collect()}
    assert got == {(r["doc_id"], brute(r["text"])[0], brute(r["text"])[5]) for r in odd.collect()}
    assert quality_rules(none).count() == 0


SYLLABLES = {
    "en": "the of and in that is was on ing er ed th an re tion st ou wh ly ble",
    "de": "der die und in den von zu mit sch ung ein heit keit er ver be ge lich en ß",
    "fr": "le la de et les des en un du que tion ment eau oux aux é è ê elle ai",
    "es": "el la de que y en los del se las ción mente ado ar os as es ñ ó ía",
}


def prose(lang, n_words, rng):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n_words))


def corpus():
    """(id, kind, text): clean prose of four languages at many lengths, hash-salted, encoded and repeating texts."""
    rng = random.Random(2)
    out = [("clean", prose(lang, n, rng)) for lang in SYLLABLES for n in (60, 90, 150, 300, 700, 1500) for _ in range(50)]
    for lang in SYLLABLES:
        words = prose(lang, 1500, rng).split()
        out.append(("hashes", " ".join(w if k % 3 else "%040x" % rng.getrandbits(160) for k, w in enumerate(words))))
        out.append(("base64", " ".join("".join(rng.choice(ALPHABET) for _ in range(60)) for _ in range(150))))
        out.append(("lines", "\n".join(f"{k} {' '.join(words[:6])} {rng.choice(words)} {k}" for k in range(300))))
    return [(i, *x) for i, x in enumerate(out)]


def brute_kept(rows, chunk=4096):
    """Verdicts by loops: quartiles of histograms of a thousand bins, class by class."""
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    judged = {}
    for i, _, text in rows:
        raw = (text or "").encode()
        pieces = [raw[a : a + chunk] for a in range(0, len(raw), chunk)] if len(raw) > chunk else []
        judged[i] = {"whole": [(len(raw), len(squeeze(raw)) / len(raw))] if len(raw) >= 256 else [], "chunk": [(len(p), len(squeeze(p)) / len(p)) for p in pieces if len(p) >= 256]}
    failed = {i: brute(text)[5] for i, _, text in rows}
    grade = lambda n: math.floor(math.log2(n) * 4)
    seen = {of: [(grade(n), min(1000, math.floor(r * 1000))) for i, x in judged.items() if not failed[i] and x["whole"] for n, r in x[of]] for of in ("whole", "chunk")}
    grades = [c for of in seen for c, _ in seen[of]]
    span = range(min(grades), max(grades) + 1)
    curve = {}
    for of in seen:
        by = {g: [b for c, b in seen[of] if c == g] for g in span}
        known = [g for g in span if by[g]]
        curve[of] = np.poly1d(np.polyfit(known, [np.mean(by[g]) for g in known], min(2, len(known) - 1), w=[len(by[g]) ** 0.5 for g in known]))

    @functools.cache
    def limits(of, c):
        for reach in range(len(span)):
            bins = sorted(min(1000, max(0, b + round(curve[of](c) - curve[of](g)))) for g, b in seen[of] if abs(g - c) <= reach)
            if len(bins) >= LEAST_RATIOS:
                break
        ends = []
        for share in (0.25, 0.75):
            want = share * len(bins)
            b = bins[max(0, math.ceil(want) - 1)]
            ends.append((b + (want - sum(x < b for x in bins)) / bins.count(b)) / 1000)
        return ends[0] - BELOW * (ends[1] - ends[0]), ends[1] + ABOVE * (ends[1] - ends[0])

    def bad(of, n, r):
        low, high = limits(of, max(span[0], min(span[-1], grade(n))))
        return r < LEAST or r > GREATEST or r < low or r > high

    out = {}
    for i, x in judged.items():
        chunks = [bad("chunk", *c) for c in x["chunk"]]
        out[i] = not failed[i] and not any(bad("whole", *c) for c in x["whole"]) and (not chunks or sum(chunks) / len(chunks) < 0.5)
    return out


def test_verdicts_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(-1, None), (-2, "")], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    want = brute_kept(rows)
    assert {i: r["kept"] for i, r in got.items()} == want | {-1: False, -2: False}
    clean = [i for i, kind, _ in rows if kind == "clean" and not got[i]["base_failed"]]
    assert len(clean) > 1000 and all(got[i]["kept"] for i in clean)
    junk = [i for i, kind, _ in rows if kind != "clean"]
    assert not any(got[i]["kept"] for i in junk) and sum(not got[i]["base_failed"] for i in junk) >= 8


def test_verdicts_on_the_supplied_documents(spark):
    """Symbol-salted prose and tables of junk, labelled 0, fall below the band; labelled prose stays."""
    sf = "/root/testdata/sf0.01"
    got = quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("not base_failed")
    counts = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert counts[0, False] >= 5 and counts.get((1, False), 0) <= 0.01 * counts[1, True]


def test_few_rows_are_judged_by_the_absolute_limits(odd, none):
    rng = random.Random(3)
    odd = odd.unionByName(odd.limit(1).selectExpr("90L as doc_id", f"'{prose('en', 300, rng)}' as text", *[c for c in odd.columns if c not in ("doc_id", "text")]))
    got = {r["doc_id"]: r for r in quality_rules(odd).collect()}
    assert got[90]["kept"] and not got[7]["kept"] and got[3]["zstd_ratio"] is None
    assert quality_rules(none).count() == 0
    assert repeated_words([b"a", b"b", b"c", b"a", b"b", b"c"]) == 6
