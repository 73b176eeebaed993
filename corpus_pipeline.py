"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the
next stage's documents. All but the last return the columns of documents, whatever their names: a
row is carried whole in a struct, so no column of a stage can clash with one of the table. An empty
table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._common import cut, id_remainder, remove_folder, working_folder
from paperloom.llm.exact_dedup import distinct_documents
from paperloom.llm.langid import UNKNOWN, fit_language_model, predict_language
from paperloom.llm.mixing import mix_sources, whole_copies
from paperloom.llm.sentencepiece_scan import encode_documents
from paperloom.llm.simhash import near_duplicates

#: Posterior probability under which no language is accepted.
LEAST_SCORE = 0.5
#: Bytes of keys that are broadcast rather than joined by a shuffle, and bytes that a key has beside its identifier.
MAX_BROADCAST, KEY_BYTES = 50_000_000, 100


def row_key(docs: DataFrame) -> Column:
    """Key of a row by its identifier and text: identifiers order as they are, null last; only repeated rows share one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, key): rows whole, beside their keys."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(docs).alias("key"))


def join_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join by key; few keys are broadcast, by their bytes."""
    keys = cut(keys)
    size = keys.agg(F.sum(KEY_BYTES + F.coalesce(F.octet_length(F.col("key.id").cast("string")), F.lit(0)))).first()[0] or 0
    return rows.join(F.broadcast(keys) if size <= MAX_BROADCAST else keys, "key", how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: not those without a letter, nor those with no clear best language.

    Learns from the same four fifths of the rows as the operator's query. Null and empty texts go;
    repeated rows stay or go together; ties of the posterior are below LEAST_SCORE or go to the
    language first in order.
    """
    model = fit_language_model(docs.filter(id_remainder("doc_id", 5) != 0))
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), predict_language(model, docs).alias("told"))
    return told.filter((F.col("told.lang_pred") != UNKNOWN) & (F.col("told.score") >= LEAST_SCORE)).select("doc.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that with the largest identifier.

    Null and empty texts are equal texts; a null identifier is the smallest. Of rows that share the
    identifier too, the one whose other columns come first as text.
    """
    return distinct_documents(docs, keep="max")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest identifier of each group of linked fingerprints, one row of each group.

    Rows are told apart by identifier and text, so an identifier may be null, the last of all, or
    shared: of texts that share it the one with the smaller hash stays, and of rows that repeat both
    the one whose columns come first as text.
    Null, empty and wordless texts form one group.
    """
    told = near_duplicates(docs.select(row_key(docs).alias("key"), F.col("text").alias("text")), id_col="key")
    groups = cut(told.groupBy("key").agg(F.max(F.col("key") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n")))
    left = join_keys(keyed(docs), groups.filter("not stays").select("key"), "left_anti")
    repeated = groups.filter("stays and n > 1").select("key")
    if not repeated.isEmpty():
        one = join_keys(left, repeated, "left_semi").groupBy("key").agg(F.min_by("doc", F.to_json("doc", {"ignoreNullFields": "false"})).alias("doc")).select("doc", "key")
        left = join_keys(left, repeated, "left_anti").select("doc", "key").union(one)
    return left.select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, none, one or two copies of each, so that sources come near their target weights.

    Texts without words go. A null source is one source. Repeated rows take the mean of their copies,
    rounded; so every run gives the same rows.
    """
    mixed = mix_sources(docs.select(row_key(docs).alias("key"), F.col("text").alias("text"), F.col("source").alias("source")), id_col="key")
    copies = mixed.groupBy("key").agg(F.floor(F.avg(whole_copies(F.col("taken"), F.col("size"), F.col("key").cast("string"))) + 0.5).cast("int").alias("copies")).filter("copies > 0")
    return keyed(docs).join(copies, "key").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again for comparison. Null and empty texts have none; repeated rows repeat."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicate_groups),
    ("mixing sources", mixture),
    ("SentencePiece encoding", sentencepiece),
]

#: Trained models and library tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what lies between them is written to the shared folder and removed once read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = working_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
