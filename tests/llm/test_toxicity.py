import random

import numpy as np

from paperloom.llm import toxicity
from paperloom.llm.toxicity import _EDGE, BITS, DIM, FILTERS, THRESHOLD, WIDTHS, ToxicityModel, features, fit, fit_toxicity, toxicity_score
from paperloom.llm.queries import op3_toxicity


def made(n, seed):
    rng = random.Random(seed)
    clean, bad = [f"{a}{b}" for a in ("on", "re", "tha", "ing") for b in ("er", "st", "al", "ou")], ["vilest", "vilely", "grubby"]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((" ".join(words), int(toxic), rng.choice(["en", "fr"])))
    return rows


def test_held_out_accuracy_and_batches():
    train, test = made(500, 1), made(300, 2)
    model = fit(*map(list, zip(*train)))
    texts, truth, _ = zip(*test)
    scores = model.score(list(texts))
    assert ((scores >= THRESHOLD) == np.array(truth, bool)).mean() > 0.97
    scorer = model.scorer()
    alone = np.concatenate([scorer.score([t]) for t in texts[:40]])
    assert np.allclose(alone, scores[:40], atol=1e-5)


def brute_logit(model, text):
    """Forward pass by loops, from the parameters alone."""
    words = [features(w) for w in (text or "").lower().translate(_EDGE).split()]
    if not words:
        return model.wordless, len(model.languages)
    vectors = [sum(model.embed[f] for f in w) for w in words] + [np.zeros(DIM)] * max(WIDTHS)
    logit = model.bias
    for k, w in enumerate(WIDTHS):
        for c in range(FILTERS):
            best = max(sum(float(vectors[i + j] @ model.filters[k][j][:, c]) for j in range(w)) for i in range(len(words)))
            logit += max(0.0, best + model.shift[k][c]) * model.out[k * FILTERS + c]
    told = [sum(float(model.word_log_prob[w[0], n]) for w in words) for n in range(len(model.languages))]
    return logit, int(np.argmax(told)) if told else 0


def random_model(languages):
    rng = np.random.default_rng(3)
    embed = rng.normal(size=(1 << BITS, DIM))
    embed[0] = 0
    return ToxicityModel(embed, [rng.normal(size=(w, DIM, FILTERS)) for w in WIDTHS], [rng.normal(size=FILTERS) for _ in WIDTHS], rng.normal(size=FILTERS * len(WIDTHS)), 0.3, languages, rng.normal(size=(1 << BITS, len(languages))).astype(np.float32), rng.normal(size=len(languages) + 1), -1.5)


def test_forward_pass_against_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n", "!!", "one", "two words"] + [" ".join(rng.choice(["Bad,", "word", "être", "(x)", "日本語", "...", "longer-word"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    for languages in ([], ["de", "en"]):
        model = random_model(languages)
        for piece_chars in (None, 1, 17, 40):  # whole, and in pieces
            logit, guess = model.scorer().logits(texts, piece_chars)
            want = [brute_logit(model, t) for t in texts]
            assert np.allclose(logit, [w[0] for w in want], atol=1e-3), piece_chars
            assert guess.tolist() == [w[1] for w in want]
        z = np.array([w[0] - model.cuts[w[1]] for w in want]) + np.log(THRESHOLD / (1 - THRESHOLD))
        assert np.allclose(model.score(texts), 1 / (1 + np.exp(-np.clip(z, -30, 30))), atol=1e-3)


def test_fit_takes_long_texts_in_part_and_one_text_an_identifier(spark):
    seen = {}
    docs = spark.createDataFrame([(1, "a" * 50 + " " + "b" * 50, "en"), (2, "short", "en"), (2, "other", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    real = toxicity.fit
    toxicity.fit = lambda *a: seen.update(texts=a[0], y=a[1]) or real(*a)
    try:
        fit_toxicity(docs, labels, max_chars=20)
    finally:
        toxicity.fit = real
    assert sorted(map(len, seen["texts"])) == [5, 20] and sorted(seen["y"]) == [0, 1]


def test_one_label_and_wordless(spark, odd, none):
    for toxic, above in ((0, False), (1, True)):
        model = fit(["a b", "c"], [toxic, toxic], ["en", None])
        assert ((model.score(["", "x y", None]) >= THRESHOLD) == above).all()
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (7, None), (None, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    for docs, told in ((odd, labels), (none, labels), (odd, labels.limit(0))):
        model = fit_toxicity(docs, told)
        got = odd.select("doc_id", toxicity_score(model, odd).alias("s")).collect()
        assert len(got) == odd.count() and all(0 <= r["s"] <= 1 for r in got)
        assert none.select(toxicity_score(model, none).alias("s")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_toxicity(spark, sf)
    told = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.filter("held_out").join(told, "doc_id").collect()
    hit = [r["score"] for r in rows if r["toxic"]]
    miss = [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([a > b for a in hit for b in miss]) > 0.75
    assert got.filter("predicted <> cast(score >= 0.3 as int)").count() == 0
