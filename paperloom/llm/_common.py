"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship

#: Words of the word-based contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that one step over a long text holds as arrays.
STEP_CHARS = 1_000_000
#: Bytes of text that one step of a vectorised UDF turns into Python strings.
STEP_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the identifier written as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; on a local master without one, a temporary folder is set."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salted_join(rows: DataFrame, table: DataFrame, key: str, draw: Column, how: str = "inner", hot_share: int = 1_000, salts: int = 64) -> DataFrame:
    """Join of ``rows`` with ``table``, which has one row for a value of the column ``key`` and the number of its rows, ``n``.

    A key with more than 1 / ``hot_share`` of the rows that ``table`` counts is hot, so there are fewer than
    ``hot_share`` of these: their rows are dealt over salts by ``draw``, and their rows of ``table`` repeated
    for each salt. ``table`` is evaluated more than once. Column n is left out of the result.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = [r[key] for r in table.filter(F.col("n") > total / hot_share).select(key).collect()]
    if not hot:
        return rows.join(table.drop("n"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(draw), F.lit(salts))).otherwise(F.lit(0)))
    repeated = table.drop("n").withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [key, "salt"], how).drop("salt")


def text_column_udf(schema: str, make: Callable[[], Callable[[list[str | None]], dict[str, list]]]) -> Callable[[Column], Column]:
    """A vectorised UDF from a text column to a struct.

    ``make`` runs once per Python worker task and returns a function from a list of texts to a
    dict of equally long columns. Spark bounds an Arrow batch by bytes
    (spark.sql.execution.arrow.maxBytesPerBatch); of a batch, about STEP_BYTES at a time become
    Python strings.
    """
    ship(SparkSession.active())
    returned = to_arrow_type(T._parse_datatype_string(schema))

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for texts in batches:
            parts = []
            for part in steps(texts):
                got = fn(part.to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in returned], fields=list(returned)))
            yield pa.concat_arrays(parts) if parts else pa.array([], returned)

    return run


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a text array that hold about STEP_BYTES bytes; at least one text each."""
    if not len(texts):
        return
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(held[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(held, before + STEP_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def working_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that working_folder named, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
