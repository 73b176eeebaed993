import random
import re

import numpy as np
import pytest
import xxhash

from paperloom.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Ab", "c", "É", "dd"]) for _ in range(n)) for n in (1, 2, 3, 4, 50, 400)] + ["", None, " \t", "x" * 5000, "a\x0bb c\x1fd"]
    assert [S.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", S.fingerprint_column(S.F.col("text")).alias("f")).collect()
    assert {(r["text"], r["f"] & (1 << 64) - 1) for r in got} == {(t, brute_fingerprint(t)) for t in texts}


def test_golay_keys_meet_within_one_bit():
    golay, rng = S.Golay(), np.random.default_rng(1)
    assert sorted(np.bincount(golay.n)[[1, 6]].tolist()) == [277, 1771]
    words = rng.integers(0, 1 << 23, 2000)
    for other in (words, *(words ^ (1 << b) for b in range(23))):
        row, key = golay.keys(other)
        held = [set() for _ in words]
        for r, k in zip(row, key):
            held[r].add(int(k))
        assert all(int(h) in x for h, x in zip(golay.home(words), held))


def test_pairs_within_three_bits_share_a_bucket():
    rng, golay = random.Random(3), S.Golay()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), 3):
            b ^= 1 << p
        ka, kb = (set(S.bucket_rows(np.array([x], np.uint64), golay)[0].tolist()) for x in (a, b))
        assert ka & kb


@pytest.mark.parametrize("bucket", [3, 4096])
def test_links_against_brute_force(spark, bucket):
    rng = random.Random(4)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for p in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << p
    fps |= {0, (1 << 64) - 1, 7}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = S.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bucket=bucket)
    roots = {r["node"]: r["root"] for r in S.connected_components(links).collect()}
    assert partition([roots.get(x, x) for x in signed]) == partition(brute_components(fps))


def test_documents(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    labels = brute_components(fps)
    least = {x: min((i for (i, _), y in zip(rows, labels) if y == x and i is not None), default=None) for x in labels}
    want = sorted(((i, format(f, "016x"), least[x]) for (i, _), f, x in zip(rows, fps, labels)), key=str)
    assert sorted(map(tuple, S.near_duplicates(odd).collect()), key=str) == want
    assert S.near_duplicates(none).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(60).selectExpr("id as u", "id + 1 as v")
    assert {r["root"] for r in S.connected_components(edges).collect()} == {0}
