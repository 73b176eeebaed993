"""Read views over stored cards, reports and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L


def keyed_cache(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """One row a key, the last in ``order``; the key is trimmed text. Combined before the shuffle."""
    held = [c for c in rows.columns]
    got = rows.groupBy(F.trim(key.cast("string")).alias("cache_key")).agg(F.max_by(F.struct(*held), F.col(order)).alias("_r"))
    return got.select("cache_key", "_r.*")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, combined before the shuffle; a null key is a key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def normalise_reports(reports: DataFrame, order: str = "row_id") -> DataFrame:
    """V1: reports (model_id, total_score, section_scores, scores_by_section, success, row_id), last of a model kept.

    section_scores may go by its other name; success is true unless stated; models without a name are skipped (F15).
    """
    named = reports.withColumn("model_id", F.trim("model_id")).filter("model_id <> ''")
    tidy = named.select("model_id", "total_score", F.coalesce("section_scores", "scores_by_section").alias("section_scores"), F.coalesce("success", F.lit(True)).alias("success"), order)
    return keyed_cache(tidy, F.col("model_id"), order).drop("cache_key")


def score_column(total: Column) -> Column:
    """V2: the score as a number, null where it is none."""
    return total.cast("string").try_cast("double")


def card_list(cards: DataFrame, scores: DataFrame, order: str = "row_id") -> DataFrame:
    """(model_id, task, score), first row of a model, sorted without regard to case."""
    named = cards.withColumn("model_id", F.trim("model_id")).filter("model_id <> ''")
    return keep_first(named, "model_id", order).join(scores.select("model_id", "score"), "model_id", "left").select("model_id", "task", "score", order).orderBy(F.lower("model_id"), order)


def read_card(cards: DataFrame, model_id: str | None = None, order: str = "row_id") -> DataFrame:
    """The asked model's first row, or the first of all; none if there is no such model."""
    named = cards.filter(F.trim("model_id") != "")
    return (named if model_id is None else named.filter(F.trim("model_id") == model_id)).orderBy(order).limit(1)


def source_payloads(models: DataFrame, cards: DataFrame, papers: DataFrame, readmes: DataFrame) -> DataFrame:
    """Each model with its card by id, and paper and readme by evened-out link.

    ``models``: (model_id, paper_link, github_link); ``cards``: (model_id, payload); the others:
    (link, payload, row_id). An empty link meets nothing.
    """
    key = lambda c: F.nullif(L.normalise_link(F.col(c)), F.lit(""))
    rows = models.withColumns({"_p": key("paper_link"), "_g": key("github_link")})
    last = lambda t, name: keyed_cache(t.select(key("link").alias("k"), "payload", "row_id").filter("k is not null"), F.col("k"), "row_id").select(F.col("cache_key"), F.col("payload").alias(name))
    of_card = keyed_cache(cards.select("model_id", "payload", "row_id"), F.col("model_id"), "row_id").select(F.col("cache_key").alias("_m"), F.col("payload").alias("card"))
    return (
        rows.join(of_card, F.col("model_id") == F.col("_m"), "left")
        .join(last(papers, "paper").withColumnRenamed("cache_key", "_pk"), F.col("_p") == F.col("_pk"), "left")
        .join(last(readmes, "readme").withColumnRenamed("cache_key", "_gk"), F.col("_g") == F.col("_gk"), "left")
        .select("model_id", "paper_link", "github_link", "card", "paper", "readme")
    )


def classify_view(predictions: DataFrame, models: DataFrame, key: str = "model_id") -> DataFrame:
    """K9: (model_id, primary_paper_url, primary_github_url, paper, model_card, github_readme, success): each source's predictions in order.

    ``models``: (model_id, primary_paper, primary_github). A source without predictions has an empty list.
    """
    shown = ["pos", "text", "predicted_label", "confidence", "top2_label", "top2_confidence", "applied_rerank_rule"]
    item = F.struct(*shown)
    kind = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in predictions.select(*shown).schema)
    lists = [F.array_sort(F.collect_list(F.when(F.col("source") == s, item))).alias(s) for s in ("paper", "model_card", "github_readme")]
    told = predictions.groupBy(key).agg(*lists)
    rows = models.select(key, F.col("primary_paper").alias("primary_paper_url"), F.col("primary_github").alias("primary_github_url")).join(told, key, "left")
    empty = F.array().cast(f"array<struct<{kind}>>")
    return rows.withColumns({s: F.coalesce(s, empty) for s in ("paper", "model_card", "github_readme")}).withColumn("success", F.lit(True))


def artifact_view(artifacts: DataFrame) -> DataFrame:
    """F16: the response's columns and counts."""
    return artifacts.select("model_id", "author", "tags", "downloads", "likes", F.size(F.coalesce("discussions", F.array())).alias("discussions_count"), F.length(F.coalesce("model_card", F.lit(""))).alias("card_chars"))
