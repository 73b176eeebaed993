"""The local embedding backend against dense algebra, and exact nearest labels against brute force."""

import numpy as np
import pytest

import __spark_entry__

from paperloom.operators import classify
from paperloom.operators import embedding as E
from paperloom.operators import nearest as N


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)


def dense(model, texts):
    return E.Rows.of_texts(texts, E.Terms(model.bits), model.idf).times(np.eye(1 << model.bits))


def test_the_basis_is_that_of_a_dense_decomposition(docs):
    model = E.fit_text_encoder(docs, dimensions=8, bits=10, more=24, iterations=6)
    a = dense(model, [r["text"] for r in docs.collect()])
    _, values, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, values[:8], rtol=1e-3)
    assert np.abs(model.basis.T @ model.basis - np.eye(8)).max() < 1e-9
    # the leading directions stand apart from the others, so they must agree one by one
    for k in range(4):
        assert abs(model.basis[:, k] @ vt[k]) > 0.999
    assert np.linalg.norm(a @ model.basis) ** 2 > 0.999 * (values[:8] ** 2).sum()
    df = np.bincount(np.concatenate([E.Terms(10).counts(r["text"])[0] for r in docs.collect()]), minlength=1 << 10)
    assert np.allclose(model.idf, np.log((1 + len(a)) / (1 + df)) + 1)


def test_few_iterations_lose_little(docs):
    model = E.fit_text_encoder(docs, dimensions=8, bits=10)
    a = dense(model, [r["text"] for r in docs.collect()])
    assert np.linalg.norm(a @ model.basis) ** 2 > 0.95 * (np.linalg.svd(a, compute_uv=False)[:8] ** 2).sum()


def test_sparse_products():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((6, 9)) * (rng.random((6, 9)) < 0.4)
    a[2] = 0
    at = [np.flatnonzero(r) for r in a]
    rows = E.Rows(np.concatenate(at).astype(np.int32), np.concatenate([r[i] for r, i in zip(a, at)]), np.concatenate([[0], np.cumsum([len(i) for i in at])]))
    m, q, into = rng.standard_normal((9, 3)), rng.standard_normal((6, 2)), np.ones((9, 2))
    rows.gather(q, into)
    assert np.allclose(rows.times(m), a @ m) and np.allclose(into - 1, a.T @ q)


def test_triangles_merge_as_a_tree(spark, docs, monkeypatch):
    once = E.fit_text_encoder(docs, dimensions=4, bits=8)
    monkeypatch.setattr(E, "FAN_IN", 2)
    again = E.fit_text_encoder(docs, dimensions=4, bits=8)
    assert np.allclose(once.basis, again.basis, atol=1e-6)


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "§ ±")], "doc_id long, text string")
    model = E.fit_text_encoder(rows, dimensions=3, bits=6)
    got = {r["doc_id"]: r["embedding"] for r in classify.embed_texts(rows, E.backend(model, rows)).collect()}
    assert got[1] is None and got[2] == got[5] == [0.0] * 3 and got[3] == got[4] and abs(np.linalg.norm(got[3]) - 1) < 1e-6
    assert not E.fit_text_encoder(rows.limit(0), dimensions=3, bits=6).basis.any()


def test_languages_are_told_from_text_alone(spark):
    got = [r for r in __spark_entry__.queries()["classify_from_text"](spark, "/root/testdata/sf0.01").collect() if r["doc_id"] % 5 == 0 and r["lang"]]
    assert len(got) > 150 and sum(r["lang"] == r["label1"] for r in got) / len(got) > 0.9


def brute(rows, labels):
    def unit(v):
        v = np.array(v, float)
        return v / np.linalg.norm(v) if v.any() else v

    out = {}
    for i, v in rows:
        if v is None:
            out[i] = (None, None)
            continue
        order = sorted((-round(float(unit(v) @ unit(c)), N.PLACES) + 0.0, x) for x, c in labels)
        two = (order + order)[:2] if len(order) == 1 else order[:2]
        out[i] = tuple((x, -s) for s, x in two) or (None, None)
    return out


def run(spark, rows, labels, **kw):
    r = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    c = spark.createDataFrame(labels, "label string, centroid array<double>")
    got = N.nearest_two(r, c, **kw).collect()
    assert len(got) == len({i for i, _ in rows})
    return {g["vec_id"]: ((g["label1"], g["score1"]), (g["label2"], g["score2"])) if g["label1"] is not None else (None, None) for g in got}


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        for x, y in zip(got[i], want[i]):
            assert x == y or x[0] == y[0] and abs(x[1] - y[1]) < 1e-8, (i, got[i], want[i])


@pytest.mark.parametrize("kw", [{}, {"max_pivots": 1}, {"max_pivots": 40, "first_balls": 1}])
def test_the_nearest_two_are_exact(spark, kw, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 5))
    draw = lambda n, far: [[float(np.float32(x)) for x in centres[rng.integers(6)] + far * rng.standard_normal(5)] for _ in range(n)]
    labels = [(f"l{k:03d}", v) for k, v in enumerate(draw(80, 0.3))] + [("zero", [0.0] * 5), ("nil", [0.0] * 5)]
    labels += [(f"twin{k}", labels[k][1]) for k in range(5)]
    rows = list(enumerate(draw(60, 1.0))) + [(100, [0.0] * 5), (101, None), (102, labels[0][1]), (103, [-float(np.float32(x)) for x in centres.sum(0)])]
    same(run(spark, rows, labels, **kw), brute(rows, labels))


def test_few_labels(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (1, [1.0, 0.0])]
    same(run(spark, rows, [("a", [2.0, 0.0])]), {1: (("a", 1.0), ("a", 1.0)), 2: (("a", 0.0), ("a", 0.0)), 3: (None, None)})
    same(run(spark, rows, [("b", [0.0, 0.0]), ("a", [0.0, 0.0])]), {1: (("a", 0.0), ("b", 0.0)), 2: (("a", 0.0), ("b", 0.0)), 3: (None, None)})
    assert run(spark, rows, []) == {1: (None, None), 2: (None, None), 3: (None, None)}
    assert N.nearest_two(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([("a", [1.0])], "label string, centroid array<double>")).count() == 0


def test_vectors_are_packed_once_a_pass(spark, monkeypatch):
    """Where the bound prunes nothing, a vector still stands in one block, not once for each ball that it visits."""
    seen, packed = [], N._packed
    monkeypatch.setattr(N, "_packed", lambda rows, *more: seen.append(rows.count()) or packed(rows, *more))
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(np.random.default_rng(1).standard_normal((120, 32)))], "vec_id long, embedding array<float>")
    got = N.nearest_two(rows, rows.select(rows["vec_id"].alias("label"), rows["embedding"].alias("centroid"))).collect()
    assert all(r["label1"] == r["vec_id"] != r["label2"] for r in got)
    assert seen == [120, 120, 120]


def test_texts_are_cut_into_words_once(spark, docs, tmp_path, monkeypatch):
    """Fit and vectors read what one pass over the texts wrote: the packed blocks are made once, and the texts are not read again."""
    seen, pack = [], E.pack_texts
    monkeypatch.setattr(E, "pack_texts", lambda rows, *more: seen.append(pack(rows, *more)) or seen[-1])
    rows = docs.unionByName(spark.createDataFrame([(10**9, None, "x", None, None), (10**9 + 1, "", None, "s", 0)], docs.schema))
    model, vectors = E.fit_and_embed(rows, dimensions=8, bits=10)
    plan = vectors._jdf.queryExecution().analyzed().toString()
    assert len(seen) == 1 and "parquet" not in plan.lower() and plan.count("MapInArrow") == 1
    assert vectors.columns == [*(c for c in docs.columns if c != "text"), "embedding"]
    want = {r["doc_id"]: r for r in classify.embed_texts(rows, E.backend(model, rows)).drop("text").collect()}
    got = {r["doc_id"]: r for r in vectors.collect()}
    assert got.keys() == want.keys() and got[10**9]["embedding"] is None and got[10**9 + 1]["embedding"] == [0.0] * 8
    for i, r in got.items():
        assert r[:-1] == want[i][:-1]
        assert r["embedding"] is None or np.allclose(r["embedding"], want[i]["embedding"], atol=1e-6)
    again = E.fit_text_encoder(rows, dimensions=8, bits=10)
    assert np.allclose(again.basis, model.basis, atol=1e-9)


@pytest.mark.parametrize("most", [0, 100])
def test_products_of_dense_and_sparse_blocks_agree(most, monkeypatch):
    monkeypatch.setattr(E, "DENSE", most)
    rows = E.Rows.of_texts(["a b b c", None, "", "c d", "?"], E.Terms(6), np.linspace(1, 2, 64))
    assert (rows.dense is None) == (most == 0)
    a = np.zeros((5, 64))
    for k in range(5):
        at = slice(rows.starts[k], rows.starts[k + 1])
        a[k, rows.columns[at]] = rows.values[at]
    assert np.allclose(np.linalg.norm(a, axis=1), [1, 0, 0, 1, 0])
    rng = np.random.default_rng(0)
    m, q, into = rng.standard_normal((64, 3)), rng.standard_normal((5, 2)), np.ones((64, 2))
    rows.gather(q, into)
    assert np.allclose(rows.times(m), a @ m) and np.allclose(into - 1, a.T @ q)


def test_one_read_of_the_rows_serves_an_iteration(docs, monkeypatch):
    reads, merged = [], E._merged
    monkeypatch.setattr(E, "_merged", lambda parts, *more: reads.append(parts) or merged(parts, *more))
    E.fit_text_encoder(docs, dimensions=4, bits=8, iterations=2)
    assert len(reads) == 1 + 3, "frequencies, and three products; each product was read twice before"


def test_sums_do_not_grow_with_partitions(spark, docs, monkeypatch):
    told, merged = [], E._merged
    monkeypatch.setattr(E, "_merged", lambda parts, *more: told.append(parts) or merged(parts, *more))
    E.fit_text_encoder(docs.repartition(60), dimensions=4, bits=8)
    assert [p.filter("block = 0").count() <= E.TASKS_A_CORE * spark.sparkContext.defaultParallelism for p in told[1:]] == [True, True]
