"""Readers of the fixed file formats, with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..shipping import ship

LIST_COLUMNS = ("links", "emails", "codes", "tables", "math", "paragraphs")
CARD_JSONL = "modelId string, task string, generator_model string, generated_card map<string,string>, error string"
REPORT_JSONL = "modelId string, emc_eval struct<total_score:string,section_scores:map<string,double>,scores_by_section:map<string,double>,success:boolean>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out where a table has fewer files than the cluster has cores.

    A file of one row group is read by one task, and so would be parsed by one. A table whose scan
    has a task for each core is left as it is: no shuffle at scale.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_json_resource(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and unreadable lines are skipped; row_id follows file and line order."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row_id"), F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    return rows.filter(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("row_id", "r.*").drop("_bad")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with every cell as text; quoted cells may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)


def read_calibration(spark: SparkSession, files: list[tuple[str, str]], label_col: str = "gt", max_rows: int = 0) -> DataFrame:
    """(text, label) of several CSVs, each with a text column of its own; paths count once, empty cells never."""
    out = None
    for path, text_col in dict(files).items():
        part = read_csv_text(spark, path).select(F.trim(text_col).alias("text"), F.trim(label_col).alias("label")).filter("text <> '' and label <> ''")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "text string, label string")
    return out.limit(max_rows) if max_rows > 0 else out


def read_payloads(spark: SparkSession, path: str, key_col: str) -> DataFrame:
    """(key, payload, row_id): list cells of a CSV parsed to arrays."""
    ship(spark)
    rows = read_csv_text(spark, path)
    lists = [values.parse_text_list(F.col(c)).alias(c) if c in rows.columns else F.array().cast("array<string>").alias(c) for c in LIST_COLUMNS]
    return rows.select(F.col(key_col).alias("key"), F.struct(*lists).alias("payload"), F.monotonically_increasing_id().alias("row_id"))


def read_four(spark: SparkSession, files: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Payload tables by name, of {name: (path, key column)}; a file that is not there gives an empty table."""
    empty = f"key string, payload struct<{', '.join(f'{c}: array<string>' for c in LIST_COLUMNS)}>, row_id long"
    out = {}
    for name, (path, key_col) in files.items():
        try:
            out[name] = read_payloads(spark, path, key_col)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = spark.createDataFrame([], empty)
    return out


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(path, tree, success) of layout JSON files, one tree a file; text that is no JSON object with children is no success."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("tree"))
    children = F.get_json_object("tree", "$.children")
    return rows.withColumn("success", F.coalesce(F.startswith(F.trim(children), F.lit("[")), F.lit(False)))


def read_pdfs(spark: SparkSession, path: str, parse) -> DataFrame:
    """(path, content, success) of PDF files. ``parse`` maps bytes to text; one that raises gives no success.

    No PDF library is bundled, so the parser is the caller's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((p, parse(bytes(raw)), True))
                except Exception:  # noqa: BLE001  a broken file is a result, not a failure
                    rows.append((p, "", False))
            yield pd.DataFrame(rows, columns=["path", "content", "success"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, content string, success boolean")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def to_json_column(rows: DataFrame, name: str = "json") -> DataFrame:
    """Every row as JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
