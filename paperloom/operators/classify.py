"""Classification by embedding centroids with keyword reranking, and by keywords alone.

Labels and phrases are constants of 7 and 157 rows. Scores against them are expressions over one
row a paragraph; the centroids are one value of a bounded number of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import vectors as V
from ..shipping import ship
from .lexicon import BENEFICIAL_PAIRS, GAP_THRESHOLD, LABELS, PHRASES

#: Labels whose centroids a task may hold; nearest.nearest_two tells the best two of any number.
MAX_LABELS = 10_000


def phrase_hits(low: Column, tokens: Column, phrases: tuple[str, ...]) -> Column:
    """C5 for one label: a phrase of several words counts as a substring, a single one as a token."""
    several, single = [p for p in phrases if " " in p], [p for p in phrases if " " not in p]
    out = F.size(F.array_intersect(tokens, F.array(*map(F.lit, single)))).cast("double") if single else F.lit(0.0)
    for p in several:
        out = out + F.contains(low, F.lit(p)).cast("double")
    return out


def keyword_scores(low: Column, tokens: Column) -> Column:
    """Array of (label_ord, label, score) in schema order."""
    return F.array(*[F.struct(F.lit(i).alias("label_ord"), F.lit(x).alias("label"), phrase_hits(low, tokens, PHRASES[x]).alias("score")) for i, x in enumerate(LABELS)])


def with_keyword_scores(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds C5's array. Lower-cased text and tokens are columns of their own, so each is made once a row."""
    low = rows.withColumn("_low", F.lower(text_col)).withColumn("_tokens", L.token_set(F.col("_low")))
    return low.withColumn(name, keyword_scores(F.col("_low"), F.col("_tokens"))).drop("_low", "_tokens")


def classify_by_keywords(paragraphs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds predicted_label, confidence, top2_label, top2_confidence.

    Ties go to the earlier label. confidence is the best score's share of all, top2_confidence the
    second score itself; without any hit the first label has confidence 0.
    """
    rows = with_keyword_scores(paragraphs, text_col, "_k")
    rows = rows.withColumn("_r", F.array_sort(F.transform("_k", lambda s: F.struct((-s["score"]).alias("neg"), s["label_ord"].alias("label_ord"), s["label"].alias("label"))))).drop("_k")
    total = F.aggregate("_r", F.lit(0.0), lambda a, s: a - s["neg"])
    best, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    return rows.withColumns({"predicted_label": best["label"], "confidence": F.when(total > 0, F.round(-best["neg"] / total, 4)).otherwise(F.lit(0.0)), "top2_label": second["label"], "top2_confidence": -second["neg"]}).drop("_r")


def embed_texts(rows: DataFrame, make_encoder, text_col: str = "text", name: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds a vector column. ``make_encoder()`` runs once a Python worker task and returns a
    function from up to ``batch`` texts to vectors; null texts keep a null vector. A table of
    precomputed vectors joined by identifier serves as well."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            out: list = [None] * len(texts)
            held = [i for i, t in enumerate(texts) if isinstance(t, str)]
            for at in range(0, len(held), batch):
                part = held[at : at + batch]
                for i, v in zip(part, encoder([texts.iloc[i] for i in part])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    ship(rows.sparkSession)
    return rows.withColumn(name, encode(F.col(text_col)))


def label_centroids(vectors: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(label, centroid), the unit mean of each label's vectors. Means combine before the shuffle."""
    parts = vectors.select(F.col(label_col).alias("label"), F.posexplode(V.as_double(F.col(vector_col))).alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    rows = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    return rows.select("label", V.l2_normalise(F.col("mean")).alias("centroid"))


def centroid_array(centroids: DataFrame) -> Column:
    """The centroids as one value, sorted by label: a scalar subquery, so that no join is needed.

    More than MAX_LABELS labels raise an error, as the value reaches every task.
    """
    held = F.array_sort(F.collect_list(F.struct("label", "centroid")))
    bounded = F.when(F.count(F.lit(1)) > MAX_LABELS, F.raise_error(F.lit(f"more than {MAX_LABELS} labels: see nearest_two"))).otherwise(held)
    return centroids.agg(bounded.alias("c")).scalar()


def with_centroid_scores(docs: DataFrame, centroids: DataFrame, vector_col: str = "embedding", name: str = "_s") -> DataFrame:
    """C4: adds an array of (neg, label) of all labels in the row itself, the best first; neg is minus the cosine, ties go to the smaller label.

    A null vector gives null.
    """
    # vector and length are columns of their own, each used more than once, so that neither is made anew for every label
    rows = docs.withColumn("_v", V.as_double(F.col(vector_col))).withColumn("_n", F.sqrt(V.dot(F.col("_v"), F.col("_v")))).withColumn("_c", centroid_array(centroids))
    cosine = lambda c: F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(V.dot(F.col("_v"), c["centroid"]) / F.col("_n"))
    scored = F.transform("_c", lambda c: F.struct((-cosine(c)).alias("neg"), c["label"].alias("label")))
    return rows.withColumn(name, F.when(F.col("_v").isNotNull(), F.array_sort(scored))).drop("_v", "_n", "_c")


def centroid_scores(docs: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, label, score, confidence) of every document and label, without a shuffle."""
    rows = with_centroid_scores(docs, centroids, vector_col).select(id_col, "_s")
    total = F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp(F.col("_s")[0]["neg"] - s["neg"]))
    rows = rows.withColumn("_total", total).withColumn("_top", F.get("_s", F.lit(0))["neg"]).select(id_col, "_total", "_top", F.explode("_s").alias("s"))
    return rows.select(id_col, F.col("s.label").alias("label"), (-F.col("s.neg")).alias("score"), (F.exp(F.col("_top") - F.col("s.neg")) / F.col("_total")).alias("confidence"))


def top_two(scored: DataFrame, name: str = "_s") -> DataFrame:
    """Adds label1, score1, label2, score2 of with_centroid_scores' array, and confidence1 and confidence2 (C8); one label stands twice."""
    first, second = F.get(name, F.lit(0)), F.coalesce(F.get(name, F.lit(1)), F.get(name, F.lit(0)))
    rows = scored.withColumns({"label1": first["label"], "score1": -first["neg"], "label2": second["label"], "score2": -second["neg"]})
    total = F.aggregate(name, F.lit(0.0), lambda a, s: a + F.exp(-s["neg"] - F.col("score1")))
    return rows.withColumn("_total", total).withColumns({"confidence1": 1.0 / F.col("_total"), "confidence2": F.exp(F.col("score2") - F.col("score1")) / F.col("_total")}).drop("_total", name)


def apply_rerank(tops: DataFrame, keyword1: Column, keyword2: Column, threshold: float | Column = GAP_THRESHOLD, pairs: tuple = BENEFICIAL_PAIRS) -> DataFrame:
    """Adds rule (gap small or pair beneficial) and final_label: the second only if its keyword score is greater."""
    pair = F.struct("label1", "label2")
    listed = pair.isin(*[F.struct(F.lit(a).alias("label1"), F.lit(b).alias("label2")) for a, b in pairs]) if pairs else F.lit(False)
    rule = ((F.col("score1") - F.col("score2")) <= (threshold if isinstance(threshold, Column) else F.lit(threshold))) | listed
    return tops.withColumn("rule", rule).withColumn("final_label", F.when(F.col("rule") & (keyword2 > keyword1), F.col("label2")).otherwise(F.col("label1")))


def classify_by_vectors(paragraphs: DataFrame, centroids: DataFrame, id_cols: list[str], text_col: str = "text", vector_col: str = "embedding", threshold: float = GAP_THRESHOLD, pairs: tuple = BENEFICIAL_PAIRS) -> DataFrame:
    """Adds predicted_label, confidence (softmax at the final label), top2_label, top2_confidence (a raw cosine), applied_rerank_rule.

    ``centroids`` are by label name; a row without a vector keeps nulls. One row stays one row: the
    scores of a paragraph are an array.
    """
    scored = with_keyword_scores(top_two(with_centroid_scores(paragraphs, centroids, vector_col)), text_col, "_kw")
    rows = scored.withColumn("_k", F.map_from_entries(F.transform("_kw", lambda k: F.struct(k["label"], k["score"]))))
    rows = apply_rerank(rows, F.coalesce(F.element_at("_k", F.col("label1")), F.lit(0.0)), F.coalesce(F.element_at("_k", F.col("label2")), F.lit(0.0)), threshold, pairs)
    final = F.when(F.col("final_label") == F.col("label2"), F.col("confidence2")).otherwise(F.col("confidence1"))
    return rows.select(*paragraphs.columns, F.col("final_label").alias("predicted_label"), F.round(final, 4).alias("confidence"), F.col("label2").alias("top2_label"), F.round("score2", 4).alias("top2_confidence"), F.col("rule").alias("applied_rerank_rule"))


def classify_sources(paragraphs: DataFrame, centroids: DataFrame | None = None, text_col: str = "text", vector_col: str = "embedding", **rules) -> DataFrame:
    """Blank paragraphs go, positions stay; vectors decide where there are any, else keywords."""
    kept = paragraphs.filter(F.col(text_col).isNotNull() & (F.trim(text_col) != ""))
    by_words = classify_by_keywords(kept, text_col).withColumn("applied_rerank_rule", F.lit(False))
    if centroids is None:
        return by_words
    with_vectors = classify_by_vectors(kept.filter(F.col(vector_col).isNotNull()), centroids, [], text_col, vector_col, **rules)
    return with_vectors.unionByName(by_words.filter(F.col(vector_col).isNull()))
