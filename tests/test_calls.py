"""Calls to services: once a request, deadlines, retries, errors, stores."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import assemble, documents, scoring
from paperloom.sources import calls as C
from paperloom.sources.calls import CallPolicy, Refused, Service

QUICK = CallPolicy(seconds=1.0, attempts=3, wait=0.01, at_once=4)


def counting(folder, answer=lambda x: x.upper()):
    """A callable that leaves a line for each call."""

    def call(request):
        with open(f"{folder}/{os.getpid()}.log", "a") as f:
            f.write(json.dumps(request) + "\n")
        return answer(request)

    return call


def made(folder):
    return sorted(json.loads(line) for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


def test_answers_keep_their_order_and_errors():
    tries = {}

    def call(x):
        tries[x] = tries.get(x, 0) + 1
        if x == "slow":
            time.sleep(5)
        if x == "late":
            time.sleep(0.2)
        if x == "refused":
            raise Refused("never")
        if x == "down" or x == "once" and tries[x] == 1:
            raise ValueError(x)
        return {"json": None, "thing": {"ä": 1}}.get(x, x * 2)

    asked = ["a", "slow", "refused", "down", "once", "late", "json", "thing", "", "a"]
    began = time.monotonic()
    got = C.ask_all(call, asked, QUICK)
    assert time.monotonic() - began < 4.9
    assert got == [("aa", None, 1), (None, C.TIMED_OUT, 3), (None, "Refused: never", 1), (None, "ValueError: down", 3), ("onceonce", None, 2), ("latelate", None, 1), (None, None, 1), ('{"ä": 1}', None, 1), ("", None, 1), ("aa", None, 1)]
    assert C.ask_all(call, [], QUICK) == []


def test_calls_under_way_are_bounded():
    under, most = set(), []

    def call(x):
        under.add(x)
        most.append(len(under))
        time.sleep(0.02)
        under.discard(x)
        return x

    C.ask_all(call, [str(i) for i in range(40)], CallPolicy(at_once=3))
    assert max(most) <= 3 and len(most) == 40


def test_waits_grow():
    at = []

    def call(x):
        at.append(time.monotonic())
        raise ValueError

    C.ask_all(call, ["x"], CallPolicy(attempts=3, wait=0.1))
    assert at[1] - at[0] >= 0.1 and at[2] - at[1] >= 0.2


def test_stalled_calls_end_a_task():
    with pytest.raises(C.TooManyStalled):
        C.ask_all(lambda x: time.sleep(2), ["a", "b", "c"], CallPolicy(seconds=0.05, attempts=1, at_once=3, most_stalled=2))
    with pytest.raises(ValueError):
        CallPolicy(attempts=0)


def test_a_request_is_asked_once_and_kept(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    rows = spark.createDataFrame([(i, f"p{i % 5}") for i in range(50)] + [(50, None), (51, ""), (52, "bad")], "k int, prompt string")

    def answer(x):
        if x == "bad":
            raise ValueError(x)
        return x.upper()

    told = C.with_answers(rows, counting(log, answer), CallPolicy(attempts=1), store=store)
    want = {r["k"]: (None, None) if r["k"] == 50 else (None, "ValueError: bad") if r["k"] == 52 else (r["prompt"].upper(), None) for r in rows.collect()}
    for _ in range(3):  # plans read the store
        assert {r["k"]: (r["answer"], r["error"]) for r in told.collect()} == want
    assert told.filter("answer is null").count() == 2
    assert made(log) == ["", "bad", "p0", "p1", "p2", "p3", "p4"]
    more = rows.union(spark.createDataFrame([(60, "new")], "k int, prompt string"))
    C.with_answers(more, counting(log, answer), CallPolicy(attempts=1), store=store).collect()
    assert made(log) == ["", "bad", "new", "p0", "p1", "p2", "p3", "p4"]
    again = C.with_answers(more, counting(log), CallPolicy(attempts=1), store=store, ask_failed_again=True)
    assert made(log).count("bad") == 2 and {r["k"]: r["answer"] for r in again.collect()}[52] == "BAD"
    assert C.answer_once(rows.limit(0).withColumnRenamed("prompt", "request"), counting(log)).count() == 0


REFS = "model_id string, section string, items array<string>"


def test_each_prompt_of_an_evaluation_is_asked_once(spark, tmp_path):
    refs = spark.createDataFrame([(f"m{i}", "Training", [f"batch size {i}"]) for i in range(6)], REFS)
    models = spark.createDataFrame([(f"m{i}",) for i in range(8)], "model_id string")
    answer = json.dumps({"evaluations": [{"point_number": 2, "score": 1}]})

    def read(prompt):
        if "batch size 3" in prompt:
            raise Refused("no")
        return answer if "batch" in prompt else ""

    got = scoring.evaluate(refs, models, Service(counting(tmp_path, read), QUICK))
    rows = {r["model_id"]: r for r in got.collect()}
    got.collect()
    assert got.count() == 8
    prompts = [r["prompt"] for r in scoring.build_prompts(refs, "model_id", models.withColumn("files", F.array().cast("array<string>"))).collect()]
    assert made(tmp_path) == sorted(set(prompts)) and len(prompts) == 8 * 6
    assert (rows["m3"]["success"], rows["m3"]["error"], rows["m3"]["total_score"]) == (False, "Refused: no", None)
    assert (rows["m1"]["total_score"], rows["m7"]["total_score"]) == (1.0, 0.0)


def test_a_column_is_computed_once_a_prompt(spark, tmp_path):
    refs = spark.createDataFrame([("m1", "Training", ["x"])], REFS)
    call = counting(tmp_path, lambda x: "")

    @F.udf("string")
    def udf(prompt):
        return call(prompt)

    got = scoring.evaluate(refs, refs, udf)
    got.collect()
    got.count()
    assert len(made(tmp_path)) == 6


def test_empty_sections_ask_nothing(spark, tmp_path):
    refs = spark.createDataFrame([("m1", "A", ["one", "two"]), ("m2", "B", ["x"]), ("m3", "B", [])], REFS)
    got = assemble.generate_cards(refs, refs, {"A": "of a", "B": "of b"}, Service(counting(tmp_path, lambda p: "said " + p[-20:]), QUICK))
    cards = {r["model_id"]: r for r in got.collect()}
    assert got.count() == 3 and len(made(tmp_path)) == 2
    assert cards["m1"]["sections"]["B"].endswith(assemble.EMPTY_TEXT) and cards["m1"]["sections"]["A"].startswith("said ")
    assert cards["m3"]["n_failed"] == 0 and all(v.endswith(assemble.EMPTY_TEXT) for v in cards["m3"]["sections"].values())


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_plans_of_drivers_stay_small(spark, sf_dir):
    from paperloom.plans.queries import QUERIES

    for name in ("evaluate_models", "generate_models"):
        assert exchanges(QUERIES[name](spark, sf_dir)) < 15, name


def test_tables_are_summarised_once_each(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# A heading of it\n\nThe first table stands here:\n\n| a | b |\n|---|---|\n| {i % 2} | 2 |\n\nThat was the table of it all.") for i in range(4)], "doc_id long, text string")
    got = documents.preprocess_markdown_tables(docs, languages=F.array(F.lit("en")), summarise=Service(counting(tmp_path, lambda t: f"A table of {t.count('|')} bars"), QUICK))
    texts = {(r["doc_id"], r["text"]) for r in got.collect()}
    got.count()
    assert len(made(tmp_path)) == 2 and {(i, "A table of 9 bars.") for i in range(4)} <= texts


def test_tables_of_a_document_are_summarised_together(spark, tmp_path):
    tables = spark.createDataFrame([(1, 1, "t1"), (1, 0, "t0"), (2, 0, "u"), (3, 0, "v"), (4, 0, "w")], "doc_id long, number int, table string")

    def answer(prompt):
        if "v" in prompt:
            raise Refused("no")
        return {'Of ["t0","t1"]': '["zero", "one", "more"]', 'Of ["u"]': "Here: ['about u']"}.get(prompt, "[]")

    got = documents.summarise_documents(tables, Service(counting(tmp_path, answer), QUICK), "Of {table}").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "zero"), (1, 1, "one"), (2, 0, "about u")] and len(made(tmp_path)) == 4
