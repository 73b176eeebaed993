import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm.exact_dedup import distinct_documents, exact_dedup, find_splitters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        key = lambda i: -1 if i is None else i
        best = (min if keep == "min" else max)(ids, key=key)
        sha, left = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            out.append((i, best, len(ids), i == best and left, sha))
            left = left and i != best
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("ranges", [{}, {"key_bytes": 2}, {"max_sample": 40}])
def test_against_brute_force(spark, keep, ranges):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Aa", "aA", "É", "é", "", None, "b" * 40 + rng.choice("cC"), f"own {i}"])) for i in range(400)]
    rows += rows[:5]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep, **ranges)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, keep)
    left = distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep, **ranges)
    text = dict(rows)
    assert sorted(map(tuple, left.collect()), key=str) == sorted(((r[0], text[r[0]]) for r in brute(rows, keep) if r[3]), key=str)


def test_texts_that_differ_late(spark):
    """Texts equal in their first 32 bytes and far beyond, a third of all rows in one group of copies."""
    rng = random.Random(6)
    head = "The same Header stands on top of every text of this source. " * 20
    rows = [(i, head + rng.choice("Aa") + str(rng.randrange(60))) for i in range(200)] + [(i, head.upper() + "copy") for i in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_splitters(docs.withColumnRenamed("doc_id", "id"), range_bytes=40_000)
    assert found.hot and len(found.cuts) >= 4 and all(len(c) > len(head) for c in found.cuts)
    assert sorted(map(tuple, exact_dedup(docs, keep="max", range_bytes=40_000).collect()), key=str) == brute(rows, "max")
    assert "xxhash64" not in next(x for x in exact_dedup(docs, keep="max")._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort [" in x)


def test_ranges_are_in_the_order_of_the_bytes(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abCZé日 ") for _ in range(rng.randrange(12))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = find_splitters(docs, range_bytes=200)
    got = docs.withColumn("start", found.start(F.col("text"))).select("text", found.place(F.col("start")).alias("r")).collect()
    norm = lambda t: t.translate(LOWER).encode()
    assert all(r["r"] == sum(c <= norm(r["text"]) for c in found.cuts) for r in got) and len({r["r"] for r in got}) > 10


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for ranges in ({}, {"range_bytes": 40}):
        for keep in ("max", "min"):
            assert sorted(map(tuple, exact_dedup(odd, keep=keep, **ranges).collect()), key=str) == brute(rows, keep)
            left = distinct_documents(odd, keep=keep, **ranges)
            assert left.columns == odd.columns
            assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((r[0] for r in brute(rows, keep) if r[3]), key=str)
    assert exact_dedup(none).count() == 0 and distinct_documents(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(odd, keep="any")


def test_rows_in_any_order_give_the_same_table(spark):
    """Rows equal in identifier and normalised text that differ elsewhere, among them hot texts."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["Copy", "cOPY", "other " + "x" * rng.randrange(4), None, ""]), rng.choice([None, "a", "b"]), rng.randrange(5)) for _ in range(300)]
    rows += [(7, "hot text " * 30, s, n) for s in ("b", "a", None) for n in (2, 1, None)] * 20
    got = []
    for k in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(k + 2)
        got.append(sorted(map(tuple, distinct_documents(docs, keep="max", range_bytes=2_000).collect()), key=str))
    assert got[0] == got[1] == got[2]


def test_a_long_shared_beginning_reaches_the_driver_once(spark, monkeypatch):
    """3,000 texts that share 60,000 characters, some of them 20,000 more, and the splitters still part them."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs = spark.range(3_000).select("id", F.concat(F.repeat(F.lit("Head"), 15_000), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("more"), 5_000)).otherwise(""), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    took = []
    collect = DataFrame.collect

    def counted(self):
        rows = collect(self)
        took.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    found = find_splitters(docs, range_bytes=4 << 20)
    assert sum(took) < 20 << 20 and len(found.cuts) > 20
    assert sum(map(len, found.cuts)) <= 9 << 20
    few = find_splitters(docs, range_bytes=4 << 20, splitter_bytes=400_000)
    assert 1 <= len(few.cuts) <= 7
    monkeypatch.undo()
    placed = docs.withColumn("r", found.place(found.start(F.col("text")))).groupBy("r").count().collect()
    assert max(r["count"] for r in placed) < 600
