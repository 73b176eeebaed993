import corpus_pipeline as C

from paperloom.llm.langid import fit_language_model, predict_language
from paperloom.llm.mixing import mix_sources
from paperloom.llm.sentencepiece_scan import MODEL
from paperloom.llm._common import id_remainder

from .test_simhash import LOWER, brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(10_001, "12 !! 34", "en", "src1", 8), (10_002, None, None, None, None)], docs.schema)).cache()
    names = docs.columns
    held = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    told = C.language_id(spark, docs, sf_dir)
    model = fit_language_model(docs.filter(id_remainder("doc_id", 5) != 0))
    want = {r["doc_id"] for r in docs.select("doc_id", predict_language(model, docs).alias("p")).collect() if r["p"]["lang_pred"] != "und" and r["p"]["score"] >= 0.5}
    assert {r["doc_id"] for r in told.collect()} == want and told.columns == names and 10_001 not in want and 10_002 not in want
    assert told.count() == len([r for r in docs.collect() if r["doc_id"] in want])

    exact = C.exact_duplicates(spark, told, sf_dir)
    best = {}
    for i, t in held(told).items():
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, -1), i)
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(best.values()) and exact.columns == names

    near = C.near_duplicate_groups(spark, exact, sf_dir)
    ids, texts = zip(*sorted(held(exact).items()))
    groups = {}
    for i, x in zip(ids, brute_components([brute_fingerprint(t) for t in texts])):
        groups[x] = min(groups.get(x, i), i)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(groups.values()) and near.columns == names

    mixed = C.mixture(spark, near, sf_dir)
    assert mixed.columns == names
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts and max(counts.values()) <= 2 and set(counts) <= set(groups.values())

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    shown = held(mixed)
    rows = C.sentencepiece(spark, mixed, sf_dir).collect()
    assert len(rows) == sum(counts.values()) and all(list(r["ids"]) == lib.encode(shown[r["doc_id"]]) and r["round_trip"] for r in rows)


def test_run(spark, sf_dir):
    got = C.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids", "n_chars", "round_trip"] and got.count() > 0
    assert [name for name, _ in C.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources", "SentencePiece encoding"]


FILTERING = (C.language_id, C.exact_duplicates, C.near_duplicate_groups, C.mixture)


def test_empty_tables_and_clashing_columns(spark, sf_dir, odd, none):
    for stage in FILTERING:
        assert stage(spark, none, sf_dir).count() == 0 and stage(spark, none, sf_dir).columns == none.columns
    assert C.sentencepiece(spark, none, sf_dir).count() == 0
    names = ["_told", "told", "_copies", "copies", "key", "doc", "_id", "_copy", "col", "h1", "range", "run", "a.b"]
    docs = odd.drop("norm", "fp", "kept").selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    for stage in FILTERING:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert all(r[n] == n for r in got.collect() for n in names)


def test_near_duplicates_without_identifiers(spark, sf_dir):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(None, base, "a"), (None, base + " end", "a"), (5, base + " ending", "a"), (8, "another text altogether", "b"), (8, "another text altogether", "b"), (8, "with a shared identifier", "b"), (None, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    groups = brute_components(prints)
    got = C.near_duplicate_groups(spark, docs, sf_dir).collect()
    assert len(got) == len(set(groups))
    assert 5 in {r["doc_id"] for r in got} and sorted(r["text"] for r in got if r["doc_id"] == 8) == ["another text altogether", "with a shared identifier"]


def test_mixture_against_takings(spark, sf_dir):
    docs = spark.createDataFrame([(k, "w " * (40 * k), "abc"[k % 3]) for k in range(60)] + [(None, "no identifier", None), (3, "repeated row", "a"), (3, "repeated row", "a")], "doc_id long, text string, source string")
    got = C.mixture(spark, docs, sf_dir)
    count = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert count(got) == count(C.mixture(spark, docs.repartition(5), sf_dir))
    size, taken = {}, {}
    for r in mix_sources(docs.select(C.row_key(docs).alias("key"), "text", "source"), id_col="key").collect():
        if r["size"]:
            size.setdefault(r["key"], r["size"])
            taken.setdefault(r["key"], []).append(r["taken"])
    copies = {}
    for r in got.collect():
        copies[r["doc_id"], r["text"]] = copies.get((r["doc_id"], r["text"]), 0) + 1
    for key, x in taken.items():
        text = next(r["text"] for r in docs.collect() if r["doc_id"] == key["id"] and len(r["text"].split()) == size[key])
        mean = sum(x) / len(x) / size[key]
        assert abs(copies.get((key["id"], text), 0) / len(x) - mean) < 1.01
