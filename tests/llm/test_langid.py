import math

from pyspark.sql import functions as F

from paperloom.llm.langid import LanguageModel, buckets, code_points, fit_language_model, predict_language
from paperloom.llm.queries import op9_language_id

import numpy as np


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op9_language_id(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = got.filter("held_out").join(docs, "doc_id")
    assert held.count() > 150
    assert held.filter("lang = lang_pred").count() / held.count() > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_batch_equals_one_by_one_and_pieces():
    rng = np.random.default_rng(0)
    model = LanguageModel(["a", "b"], rng.normal(size=(1 << 8, 2)).astype(np.float32), np.log([0.5, 0.5]), 8)
    texts = ["héllo wörld", "x", "", None, "12 34", "ab", "longer text, with Words"]
    together, alone = model.predict(texts), [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])
    points = code_points("abc " * 50)
    whole = sum(model.log_prob[buckets(points, o, 8)].sum(axis=0, dtype=np.float64) for o in (1, 2, 3))
    assert np.allclose(model._sum_long(points), whole, atol=1e-3)


def brute_bucket(gram, bits):
    h = gram[0]
    for c in gram[1:]:
        h = (h * 0x200003 + c) % 2**64
    return ((h + len(gram)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def brute_grams(text, bits):
    points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
    return [brute_bucket(points[i : i + n], bits) for n in (1, 2, 3) for i in range(len(points) - n + 1)]


def test_fit_and_posterior_against_brute_force(spark):
    """Counts, smoothing, priors and posteriors by dictionaries."""
    rows = [(1, "der die das", "de"), (2, "the and of", "en"), (3, "the über", "de"), (3, "the über", "de"), (4, "", "fr"), (5, None, "en"), (6, "lost", None), (7, "x", "en"), (8, "12 34", "es")]
    bits = 10
    model = fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=bits)
    used = [(t, la) for _, t, la in rows if t is not None and la is not None]
    langs = sorted({la for _, la in used})
    assert model.languages == langs
    counts = {la: {} for la in langs}
    for t, la in used:
        for b in brute_grams(t, bits):
            counts[la][b] = counts[la].get(b, 0) + 1
    log_prob = {la: [math.log((counts[la].get(b, 0) + 0.5) / (sum(counts[la].values()) + 0.5 * 2**bits)) for b in range(2**bits)] for la in langs}
    for k, la in enumerate(langs):
        assert np.allclose(model.log_prob[:, k], log_prob[la], atol=1e-5)
    texts = ["the die", "über x", "é", "zzz", "a1", "The, THE the!"]
    names, scores = model.predict(texts)
    for t, name, score in zip(texts, names, scores):
        total = {la: math.log(sum(x == la for _, x in used) / len(used)) + sum(log_prob[la][b] for b in brute_grams(t, bits)) for la in langs}
        top = max(total.values())
        post = {la: math.exp(v - top) / sum(math.exp(x - top) for x in total.values()) for la, v in total.items()}
        assert name == max(langs, key=total.get) and abs(score - post[name]) < 1e-3


def test_many_languages_go_in_small_steps():
    rng = np.random.default_rng(1)
    model = LanguageModel([f"l{k:03}" for k in range(300)], rng.normal(size=(1 << 8, 300)).astype(np.float32), np.zeros(300), 8)
    assert model.step_chars < 14_000
    texts = ["some words " * 40, "more of them " * 3_000, "and short"] * 5
    together, alone = model.predict(texts), [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone], atol=1e-6)


def test_odd_rows(spark, odd, none):
    model = fit_language_model(odd)
    got = {r["doc_id"]: r["p"] for r in odd.select("doc_id", predict_language(model, odd).alias("p")).collect()}
    assert all(tuple(got[i]) == ("und", 0.0) for i in (3, 4, 5))
    assert got[1]["lang_pred"] in ("en", "fr", "de", "es")
    empty = fit_language_model(none)
    assert empty.languages == []
    assert {r["p"]["lang_pred"] for r in odd.select(predict_language(empty, odd).alias("p")).collect()} == {"und"}
    assert none.select(predict_language(model, none).alias("p")).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    model = fit_language_model(docs, max_rows_per_language=100)
    assert model.languages == ["en"]
