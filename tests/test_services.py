"""Drivers, readers and the queries of plans.services against DuckDB."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import assemble, scoring, tuning
from paperloom.plans import services
from paperloom.plans.queries import QUERIES
from paperloom.sources import readers


def tidy(v):
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_service_queries_match_duckdb(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings", "events"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert set(services.ORACLE_SQL) <= set(QUERIES)
    for name, text in services.ORACLE_SQL.items():
        got = QUERIES[name](spark, sf_dir)
        cols = sorted(got.columns)
        mine = sorted(tuple(map(tidy, r)) for r in got.select(*cols).collect())
        theirs = sorted(tuple(map(tidy, r)) for r in db.sql(f"select {', '.join(cols)} from ({text})").fetchall())
        assert mine == theirs and mine, name


def test_page_words_of_cut_references_match_duckdb(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pages = ["<h1>token = &quot</h1><p>a &amp b &#x27 c &lt</p>", "<b>&quot;x&quot; &ampquot; &amp;quot; &quo &</b>", None, "", "a\x0bb \r\n c", "<a href='?a=1&copy=2'>\ufdd0 &copy 1 &middot; 2</a>&quot", "<script>if (a&&b&lt) c;</script><p>&#39;&#39</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["page_words"](spark, str(tmp_path)).select("page_id", "n_chars", "digest").collect())
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(f"select page_id, n_chars, digest from ({services.ORACLE_SQL['page_words']})").fetchall())


def test_markdown_tables_shuffles_no_text(spark, sf_dir):
    """Each document's levels are counted in its own row; grouping them again moved every text."""
    plan = QUERIES["markdown_tables"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("ArrowEvalPython") == 1


def test_evaluate(spark):
    refs = spark.createDataFrame([("m1", "Training", ["batch size 3"]), ("m2", "Training", ["x"])], "model_id string, section string, items array<string>")
    models = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model_id string")
    answer = json.dumps({"evaluations": [{"point_number": 2, "score": 1}, {"point_number": 2, "score": 0.5}, {"point_number": 3, "score": 7}]})
    scorer = lambda p: F.struct(F.when(F.contains(p, F.lit("batch")), F.lit(answer)).otherwise("junk").alias("answer"), F.when(F.contains(p, F.lit("['x']")), F.lit("down")).alias("error"))
    got = {r["model_id"]: r for r in scoring.evaluate(refs, models, scorer).withColumn("order", F.map_keys("section_scores")).collect()}
    assert (got["m1"]["success"], got["m1"]["total_score"], got["m1"]["section_scores"]["Training"], got["m1"]["scores_by_point"][2]) == (True, 0.5, 1.5, 0.5)
    assert got["m1"]["order"][:2] == ["Model details", "Training"]
    assert (got["m2"]["success"], got["m2"]["error"], got["m2"]["section_scores"]) == (False, "down", None)
    assert got["m3"]["success"] and got["m3"]["total_score"] == 0.0 and len(got["m3"]["scores_by_point"]) == 22
    assert {(r["success"], r["error"]) for r in scoring.evaluate(refs, models).collect()} == {(False, scoring.NOT_CONFIGURED)}
    plain = scoring.evaluate(refs, models, lambda p: F.lit(answer)).collect()
    assert len(plain) == 3 and all(r["success"] for r in plain)
    assert scoring.evaluate(refs.limit(0), models.limit(0), scorer).count() == 0


def test_generate(spark):
    refs = spark.createDataFrame([("m1", "A", ["one", "two"]), ("m1", "B", ["x"]), ("m1", "C", ["y"])], "model_id string, section string, items array<string>")
    models = spark.createDataFrame([("m1",), ("m2",)], "model_id string")
    seen = lambda s, p: F.struct(F.when(s == "C", "  ").otherwise(F.concat(F.lit(" "), p)).alias("text"), F.when(s == "B", F.lit("e" * 600)).alias("error"))
    got = {r["model_id"]: r for r in assemble.generate_cards(refs, models, {"A": "spec of a", "B": "", "C": "", "D": ""}, seen).withColumn("order", F.map_keys("sections")).collect()}
    a = got["m1"]["sections"]
    assert got["m1"]["order"] == ["A", "B", "C", "D"] and "spec of a" in a["A"] and "- one\n- two" in a["A"] and not a["A"].startswith(" ")
    assert a["B"] == "### B\n\n[Generation Failed: " + "e" * 500 + "]" and "empty text" in a["C"] and a["D"].endswith("[More information needed]")
    assert got["m1"]["n_failed"] == 2 and got["m1"]["full_markdown"] == "\n\n".join(a[k] for k in "ABCD") and got["m1"]["success"]
    assert got["m2"]["n_failed"] == 0 and got["m2"]["full_markdown"].count("[More information needed]") == 4
    assert {(r["success"], r["error"]) for r in assemble.generate_cards(refs, models, {"A": ""}).collect()} == {(False, assemble.NOT_CONFIGURED)}


def test_readers_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("modelId,links\nm1,\"['u', 'v']\"\n")
    (tmp_path / "ok.json").write_text('{"children": [{"block_type": "Text"}]}')
    (tmp_path / "bad.json").write_text("[1]")
    got = readers.read_four(spark, {"cards": (str(tmp_path / "a.csv"), "modelId"), "papers": (str(tmp_path / "none.csv"), "link")})
    assert got["cards"].first()["payload"]["links"] == ["u", "v"] and got["papers"].count() == 0
    assert got["papers"].columns == got["cards"].columns
    assert sorted((r["path"].rsplit("/", 1)[1], r["success"]) for r in readers.read_layouts(spark, f"{tmp_path}/*.json").collect()) == [("bad.json", False), ("ok.json", True)]


def test_split_holds_no_label_in_a_task(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, F.lit("a")).when(F.col("id") < 490, F.lit(None)).when(F.col("id") < 491, F.lit("one")).otherwise("b").alias("label"))
    got = tuning.stratified_split(rows)
    assert {(r["label"], r["part"]): r["count"] for r in got.groupBy("label", "part").count().collect()} == {("a", "test"): 240, ("a", "validation"): 160, (None, "test"): 54, (None, "validation"): 36, ("one", "test"): 1, ("b", "test"): 5, ("b", "validation"): 4}
    assert got.columns == ["doc_id", "label", "part"] and "_digits" in got._jdf.queryExecution().executedPlan().toString()


def test_table_summariser_and_settings(spark):
    from paperloom.operators import config, documents

    assert config.first_setting(("a", "b"), {"a": " ", "b": " x "}) == "x" and config.first_setting(("a",), {}) == ""
    tables = spark.createDataFrame([("d", 0, "| a |"), ("d", 1, None)], "doc_id string, number int, table string")
    assert config.TableSummariser(lambda m, t: str, "m", "").column is None
    summarise = config.TableSummariser(lambda m, t: (lambda x: f"{m} {t} {x}"), "m", "t").column
    got = {r["number"]: r["summary"] for r in documents.summarise_tables(tables, summarise=summarise).collect()}
    assert got == {0: "m t | a |", 1: None}
