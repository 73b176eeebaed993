"""Classification, tuning, scoring, assembly, cards, sources and streams."""

import math

import pytest
from pyspark.sql import functions as F

from paperloom.operators import assemble as A
from paperloom.operators import cards as C
from paperloom.operators import classify as K
from paperloom.operators import lexicon as X
from paperloom.operators import scoring as S
from paperloom.operators import tuning as U
from paperloom.sources import readers, retrieval
from paperloom.streaming import stages


def test_keywords(spark):
    df = spark.createDataFrame([(0, "batch size and learning rate"), (1, "nothing here"), (2, "training training email"), (3, "Runs")], "k int, text string")
    got = {r["k"]: (r["predicted_label"], r["confidence"], r["top2_label"], r["top2_confidence"]) for r in K.classify_by_keywords(df).collect()}
    assert got[0] == ("Training", 1.0, "Model details", 0.0)
    assert got[1] == ("Model details", 0.0, "Limitations, bias, and risk", 0.0)
    assert got[2] == ("Training", 0.5, "Contact", 1.0)
    assert got[3][1] == 0.0
    assert X.phrase_table(spark).count() == sum(map(len, X.PHRASES.values())) and X.checklist_table(spark).count() == 22


def test_vectors(spark):
    centroids = K.label_centroids(spark.createDataFrame([("Training", [1.0, 0.0]), ("Training", [1.0, 0.0]), ("Evaluation", [0.0, 2.0]), ("Contact", [0.0, 0.0])], "label string, embedding array<float>"))
    held = {r["label"]: r["centroid"] for r in centroids.collect()}
    assert held == {"Training": [1.0, 0.0], "Evaluation": [0.0, 1.0], "Contact": [0.0, 0.0]}
    rows = spark.createDataFrame([(0, "the evaluation of it", [1.0, 0.9]), (1, "training", [1.0, 0.9]), (2, "x", None), (3, " ", [1.0, 0.0])], "pos int, text string, embedding array<float>")
    got = {r["pos"]: r for r in K.classify_sources(rows, centroids).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0]["predicted_label"] == "Evaluation" and got[0]["top2_label"] == "Evaluation" and got[0]["applied_rerank_rule"]
    assert got[1]["predicted_label"] == "Training"
    n = math.hypot(1, 0.9)
    e = [math.exp(1 / n), math.exp(0.9 / n), 1.0]
    assert got[1]["confidence"] == round(e[0] / sum(e), 4) and got[2]["confidence"] == 0.0


def test_gap_and_pairs(spark):
    tops = spark.createDataFrame([(1, 0.5, 2, 0.49, 0, 1), (1, 0.5, 2, 0.3, 0, 1), (3, 0.5, 4, 0.1, 0, 1), (1, 0.5, 2, 0.5, 1, 1)], "label1 int, score1 double, label2 int, score2 double, k1 int, k2 int")
    got = K.apply_rerank(tops, F.col("k1"), F.col("k2"), 0.0101, ((3, 4),)).collect()
    assert [(r["rule"], r["final_label"]) for r in got] == [(True, 2), (False, 1), (True, 4), (True, 1)]


def test_tuning(spark):
    rows = [(i, i % 2, 0.5, 1 - i % 2, 0.5 - (i % 11) / 100, (i % 3 == 0) * 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label1 int, score1 double, label2 int, score2 double, truth int").withColumn("swapped", F.col("label2"))
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label int")

    def f1(pred):
        out = []
        for x in (0, 1, 2):
            tp = sum(p == x == r[5] for p, r in zip(pred, rows))
            n = sum(p == x for p in pred) + sum(r[5] == x for r in rows)
            out.append(2 * tp / n if tp else 0.0)
        return sum(out) / 3

    got = {r["step"]: r["macro_f1"] for r in U.threshold_scores(df, labels).collect()}
    assert len(got) == 101
    for step in (0, 1, 9, 10, 11, 55, 100):
        want = f1([r[3] if round(r[2] - r[4], 9) <= step * 0.001 + 1e-12 else r[1] for r in rows])
        assert abs(got[step] - want) < 1e-12
    parts = U.stratified_split(df, "vec_id", "truth").groupBy("truth", "part").count().collect()
    assert {(r["truth"], r["part"]): r["count"] for r in parts} == {(0, "test"): 24, (0, "validation"): 16, (1, "test"): 12, (1, "validation"): 8}
    tuned = U.tune(df, labels, "vec_id")
    status = tuned.status().first()
    assert tuned.measures.count() == 2 and status["tuned"] and status["rows_validation"] + status["rows_test"] == 60 and tuned.threshold == status["threshold"]
    assert [tuple(p) for p in status["beneficial_pairs"]] == sorted((r["label1"], r["label2"]) for r in tuned.pairs.collect())
    few = U.tune(df.limit(19), labels, "vec_id")
    assert few.threshold is None and few.measures.count() == few.pairs.count() == 0
    assert (few.status().first()["tuned"], few.status().first()["beneficial_pairs"]) == (False, [])
    single = spark.createDataFrame([(1, "a")], "doc_id long, label string")
    assert U.stratified_split(single).first()["part"] == "test"


def test_scores(spark):
    items = spark.createDataFrame([("m", "Training", 0, 2, "q", "r", "1"), ("m", "Training", 1, 2, "q", "r", "0.5"), ("m", "Files", 0, 19, "q", "r", "0.7")], "model_id string, section string, ord int, point_number int, evidence_quote string, reasoning string, score string")
    filled = S.fill_and_score(items, items)
    assert filled.count() == 3 + 1 + 4 + 1 + 1  # sections without items get their points
    assert {r["section"]: r["score"] for r in S.section_scores(filled).collect()}["Training"] == 1.5
    assert S.total_scores(filled).first()["total_score"] == 0.5
    refs = spark.createDataFrame([("m", "Training", ["it's", 'say "x"', "both ' \"", "a\\b\n"])], "model_id string, section string, items array<string>")
    files = spark.createDataFrame([("m", ["run.py"])], "model_id string, files array<string>")
    prompts = {r["section"]: r["prompt"] for r in S.build_prompts(refs, files=files).collect()}
    assert repr(["it's", 'say "x"', "both ' \"", "a\\b\n"]) in prompts["Training"] and "['run.py']" in prompts["Files"] and "[]" in prompts["Evaluation"]
    assert S.read_answers(S.stub_answers(spark.createDataFrame([("m", "Training", "p")], "model_id string, section string, prompt string"))).count() == 0


def test_cards(spark):
    preds = spark.createDataFrame([("m", "github_readme", 0, "g [0:LINK]", "Training"), ("m", "paper", 1, "p1", "Training"), ("m", "paper", 0, "p0", "Training"), ("n", "other", 0, "o", "Contact")], "model_id string, source string, pos int, text string, predicted_label string")
    names = spark.createDataFrame([("m", "github_readme", {"[0:LINK]": "[GH_0:LINK]"})], "model_id string, source string, names map<string,string>")
    refs = A.grouped_references(preds, names=names)
    assert {r["model_id"]: r["items"] for r in refs.collect()} == {"m": ["p0 [Source: RP]", "p1 [Source: RP]", "g [GH_0:LINK] [Source: GH]"], "n": ["o [Source: OTHER]"]}
    card = {r["model_id"]: r for r in A.assemble_cards(refs, preds).collect()}["m"]
    assert card["n_empty"] == 6 and card["full_markdown"].startswith("### Model details\n\n[More information needed]\n\n### Limitations")
    failed = spark.range(1).select(A.section_text(F.lit("S"), F.array(F.lit("x")), F.lit("ok"), F.lit("e" * 600)).alias("t")).first()["t"]
    assert failed == "### S\n\n[Generation Failed: " + "e" * 500 + "]"
    assert A.label_counts(preds).filter("source is null").count() == 2


def test_keyed_joins(spark):
    rows = spark.createDataFrame([(" a ", 1, "x"), ("a", 2, "y"), ("", 3, "z")], "k string, row_id long, v string")
    assert {r["cache_key"]: r["v"] for r in C.keyed_cache(rows, F.col("k"), "row_id").collect()} == {"a": "y", "": "z"}
    models = spark.createDataFrame([("m", "http://A/p.pdf", ""), ("n", None, "https://g/r.git")], "model_id string, paper_link string, github_link string")
    payload = lambda *r: spark.createDataFrame(r, "link string, payload string, row_id long")
    got = {r["model_id"]: (r["card"], r["paper"], r["readme"]) for r in C.source_payloads(models, spark.createDataFrame([("m", "c", 0)], "model_id string, payload string, row_id long"), payload(("https://a/p", "P", 0), ("", "empty", 1)), payload(("https://g/r", "old", 0), ("https://G/R/", "new", 1))).collect()}
    assert got == {"m": ("c", "P", None), "n": (None, None, "new")}
    listed = spark.createDataFrame([("b", "t1", 0), ("A", "t2", 1), ("b", "t3", 2), (" ", "t", 3)], "model_id string, task string, row_id long")
    scores = spark.createDataFrame([("b", 2.5)], "model_id string, score double")
    assert [(r["model_id"], r["task"], r["score"]) for r in C.card_list(listed, scores).collect()] == [("A", "t2", None), ("b", "t1", 2.5)]
    assert C.read_card(listed).first()["model_id"] == "b" and C.read_card(listed, "none").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"modelId": "a", "task": "t"}\n\nbroken\n{"modelId": "b"}\n')
    got = readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), readers.CARD_JSONL).orderBy("row_id").collect()
    assert [r["modelId"] for r in got] == ["a", "b"]
    (tmp_path / "p.csv").write_text('paragraphs,gt,modelId,links\n"one, two",X,m,"[\'u\', \'v\']"\n,Y,n,nan\n" three ",Z,o,"[""w""]"\n')
    rows = readers.read_calibration(spark, [(str(tmp_path / "p.csv"), "paragraphs")])
    assert [tuple(r) for r in rows.collect()] == [("one, two", "X"), ("three", "Z")]
    assert readers.read_calibration(spark, [(str(tmp_path / "p.csv"), "paragraphs")], max_rows=1).count() == 1
    lists = {r["key"]: r["payload"]["links"] for r in readers.read_payloads(spark, str(tmp_path / "p.csv"), "modelId").collect()}
    assert lists == {"m": ["u", "v"], "n": [], "o": ["w"]}
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    pdfs = {r["path"][-5:]: (r["content"], r["success"]) for r in readers.read_pdfs(spark, str(tmp_path / "*.pdf"), lambda raw: raw.decode()).collect()}
    assert pdfs == {"a.pdf": ("ok", True), "b.pdf": ("", False)}
    readers.write_jsonl(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert readers.to_json_column(rows).first()["json"] == '{"text":"one, two","label":"X"}'


def test_retrieval(spark):
    models = spark.createDataFrame([("m",), ("n",)], "model_id string")
    info = spark.createDataFrame([("m", "card", ["t"])], "model_id string, model_card string, tags array<string>")
    links = spark.createDataFrame([("m", "P", ["Q"], "https://github.com/O/R/tree/main/x/y", [])], "model_id string, primary_paper string, secondary_papers array<string>, primary_github string, secondary_github array<string>")
    repos = spark.createDataFrame([("o", "r", "read me", ["a.py"])], "owner string, repo string, readme string, files array<string>")
    papers = spark.createDataFrame([("P", "text", None)], "primary_paper string, paper_content string, paper_json string")
    files = spark.createDataFrame([("m", "f2"), ("m", "f1")], "model_id string, file string")
    got = {r["model_id"]: r for r in retrieval.retrieve(models, info, links, repos, papers, files=files).collect()}
    assert (got["m"]["readme"], got["m"]["repo_files"], got["m"]["files"], got["m"]["paper_content"]) == ("read me", ["a.py"], ["f1", "f2"], "text")
    assert (got["n"]["model_card"], got["n"]["files"], got["n"]["readme"]) == (None, [], "")
    text = spark.createDataFrame([(None, None, "aGk="), (None, None, "%%"), ("raw", "d", None)], "a string, b string, c string").select(retrieval.readme_text(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()
    assert [r["t"] for r in text] == ["hi", "", "raw"]
    trees = spark.createDataFrame([("x", "master", "blob", "m"), ("y", "master", "blob", "m"), ("y", "main", "blob", "a"), ("y", "main", "tree", "d"), ("z", "dev", "blob", "q")], "repo string, branch string, kind string, path string")
    assert {r["repo"]: r["files"] for r in retrieval.repository_files(trees).collect()} == {"x": ["m"], "y": ["a"]}


def test_streams(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stages.sentence_stage(stages.read_stream(spark, str(tmp_path / "in"), docs.schema))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, stages.sentence_stage(docs).collect()))
    p = stages.write_progress(stages.read_stream(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "events"), str(tmp_path / "cp2"), "read", 3)
    p.awaitTermination(120)
    told = spark.read.json(f"{tmp_path}/events/*")
    assert [(r["completed"], r["total"]) for r in told.filter("type = 'result'").collect()] == [(3, 3)]
    events = told.filter("type = 'progress'").orderBy("completed").collect()
    assert [(r["completed"], r["remaining"]) for r in events] == [(1, 2), (2, 1), (3, 0)] and sum(r["rows"] for r in events) == docs.count()
    timed = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert stages.windowed_counts(timed).first()["n"] == 1


def test_named_queries_match_duckdb(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from paperloom.plans.oracle import ORACLE_SQL
    from paperloom.plans.queries import QUERIES

    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings", "events"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert set(ORACLE_SQL) < set(QUERIES)
    for name in ("flagship", "github_rank", "paper_rank", "heading_sections", "threshold_search", "checklist_scores", "placeholder_apply"):
        got = QUERIES[name](spark, sf_dir)
        cols = sorted(got.columns)
        tidy = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        mine = sorted(tuple(tidy(r[c]) for c in cols) for r in got.collect())
        frame = db.sql(ORACLE_SQL[name]).df()
        theirs = sorted(tuple(tidy(v.item() if hasattr(v, "item") else v) for v in r) for r in frame[cols].itertuples(index=False))
        assert mine == theirs and mine, name


def test_embedding_and_rules(spark):
    from paperloom.operators import config

    rows = spark.createDataFrame([(0, "ab"), (1, None), (2, "abc")], "k int, text string")
    got = {r["k"]: r["embedding"] for r in K.embed_texts(rows, lambda: (lambda texts: [[len(t), 1.0] for t in texts]), batch=1).collect()}
    assert got == {0: [2.0, 1.0], 1: None, 2: [3.0, 1.0]}
    rules = config.rules_from_json('{"labels": ["a"], "beneficial_pairs": [["a", "b"], ["c"], 3], "model_name": "m"}')
    assert (rules.threshold, rules.pairs) == (0.0, (("a", "b"),))
    assert config.resolve_model_name(" ", "s ", "x") == "s" and config.resolve_model_name(None, "", "x") == "x"
    assert config.resolve_rules(rules, "other", {}) is rules and config.cache_key(False, "m") == "local:m"
    assert config.use_remote(None, "remote") and not config.use_remote(False, "remote")
    prompt = spark.range(1).select(A.generation_prompt(F.lit("S"), F.lit("spec"), F.array(F.lit("r1"), F.lit("r2"))).alias("p")).first()["p"]
    assert '"S" section' in prompt and "- r1\n- r2" in prompt and "{" not in prompt
