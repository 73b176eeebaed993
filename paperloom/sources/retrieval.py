"""Retrieval as joins: what services would answer are tables, and a join is their cache.

Every external service is a table that the caller fills; nothing here reaches a network. A model
whose row is missing from a table keeps nulls or empty arrays, as a failed call would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L

TREE_BRANCHES = ("main", "master")


def join_artifacts(models: DataFrame, info: DataFrame, discussions: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Models with their card and metadata; (model_id, title, num, ...) and (model_id, file) gather into arrays."""
    out = models.join(info, "model_id", "left")
    for table, name, item, kind in ((discussions, "discussions", None, None), (files, "files", "file", "array<string>")):
        if table is not None:
            value = F.struct(*[c for c in table.columns if c != "model_id"]) if item is None else F.col(item)
            held = table.groupBy("model_id").agg(F.array_sort(F.collect_list(value)).alias(name))
            out = out.join(held, "model_id", "left")
            out = out.withColumn(name, F.coalesce(name, F.array().cast(kind or held.schema[name].dataType)))
    return out


def join_papers(candidates: DataFrame, papers: DataFrame, id_col: str = "candidate") -> DataFrame:
    """S3: title and summary by archive identifier."""
    return candidates.join(papers.withColumnRenamed("arxiv_id", id_col), id_col, "left")


def readme_text(raw: Column, download: Column, encoded: Column) -> Column:
    """The first of direct text, downloaded text and base-64 content, else empty."""
    return F.coalesce(raw, download, F.try_to_binary(encoded, F.lit("base64")).cast("string"), F.lit(""))


def repository_files(trees: DataFrame, key: str = "repo") -> DataFrame:
    """(key, files) of the first branch, main before master, that has a tree; blobs only."""
    order = F.when(F.col("branch") == TREE_BRANCHES[0], 0).when(F.col("branch") == TREE_BRANCHES[1], 1)
    blobs = trees.withColumn("_o", order).filter(F.col("_o").isNotNull()).groupBy(key, "_o").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "blob", F.col("path")))).alias("files"))
    return blobs.groupBy(key).agg(F.min_by("files", "_o").alias("files"))


def join_repositories(models: DataFrame, repos: DataFrame, link_col: str = "primary_github") -> DataFrame:
    """Owner, repo and sub_path of a link, with the repository's readme and files; empty where a part is missing.

    ``repos``: (owner, repo, readme, files).
    """
    parts = L.github_parts(F.lower(F.col(link_col)))
    rows = models.withColumn("_g", parts)
    table = repos.select(F.lower("owner").alias("_o"), F.lower("repo").alias("_r"), "readme", F.col("files").alias("repo_files"))
    joined = rows.join(table, (F.col("_g.owner") == F.col("_o")) & (F.col("_g.repo") == F.col("_r")) & (F.col("_g.owner") != "") & (F.col("_g.repo") != ""), "left")
    return joined.withColumn("readme", F.coalesce("readme", F.lit(""))).withColumn("repo_files", F.coalesce("repo_files", F.array().cast("array<string>"))).drop("_g", "_o", "_r")


def retrieve(models: DataFrame, info: DataFrame, links: DataFrame, repos: DataFrame, papers: DataFrame, discussions: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row a model with everything that is known of it; without a card the rest stays null.

    ``links``: (model_id, primary_paper, secondary_papers, primary_github, secondary_github);
    ``papers``: (primary_paper, paper_content, paper_json).
    """
    got = join_artifacts(models, info, discussions, files)
    got = join_repositories(got.join(links, "model_id", "left"), repos)
    return got.join(papers, "primary_paper", "left")
