"""A keyed cache that follows its files: the last row of a key wins, whatever order the files come in.

Each row has a version, by default the time its file was changed and its place there. State is Spark's own
streaming aggregate: the newest version of a key with its row or, after a delete, with none; a row older
than what is held, as in a file that comes late, changes nothing. No Python runs per key. The stream tells
each change once; the cache itself is read from the state of the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSION = ("modified", "place")
HELD = "modified timestamp, place long, deleted boolean, row string"
CHANGE = f"cache_key string, {HELD}"


def read_versions(spark: SparkSession, path: str, schema, files_per_batch: int = 1, latest: str = "3650d") -> DataFrame:
    """A folder of Parquet files as a stream; each row with the time its file was changed and its place in the file.

    A file changed more than ``latest`` before the newest one is not read: the stream remembers the
    names of the files within that time.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", latest).parquet(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.row_index").alias("place"))


def follow(rows: DataFrame, key: Column, deleted: Column | None = None) -> DataFrame:
    """The changes (cache_key, modified, place, deleted, row) of a stream with columns modified and place.

    ``row`` is the row's other columns as JSON, null where ``deleted`` holds. The key is trimmed text;
    rows without one are left out. A version that comes again, as in a replayed batch, is no change: of one
    version the row that came in the earliest batch is held, and a change is what came in this batch. The
    query that runs it is ``run_changes``.
    """
    ship(rows.sparkSession)
    held = [c for c in rows.columns if c not in VERSION]
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    told = rows.select(F.trim(key.cast("string")).alias("cache_key"), "modified", "place", gone.alias("deleted"), F.to_json(F.struct(*held)).alias("row")).filter("cache_key <> '' and modified is not null")
    # the time of a batch is the same in all its tasks and, as it stands in the checkpoint, in its replay
    batch = F.unix_micros(F.current_timestamp())
    newest = F.max(F.struct("modified", "place", "came", "deleted", F.when(~F.col("deleted"), F.col("row")).alias("row")))
    return told.withColumn("came", -batch).groupBy("cache_key").agg(newest.alias("last")).filter(F.col("last.came") == -batch).select("cache_key", *[f"last.{c}" for c in ("modified", "place", "deleted", "row")])


@contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """The state provider that keyed state needs, for the queries started and caches read within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_changes(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in all files that have come, batch by batch, and adds the changes to a Parquet folder, a folder a batch; a restart goes on from its checkpoint.

    A batch that is replayed writes its own folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_provider(changes.sparkSession):
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_cache(spark: SparkSession, checkpoint: str, schema: str) -> DataFrame:
    """The cache as it stands at the query's last batch: cache_key, modified, place and the row's columns; deleted keys are left out."""
    with state_provider(spark):
        state = spark.read.format("statestore").load(checkpoint)
        held = cut(state.select("key.cache_key", F.col(f"value.`{state.schema['value'].dataType.names[0]}`").alias("last")).select("cache_key", "last.*"))
    live = held.filter("not deleted")
    return live.select("cache_key", "modified", "place", F.from_json("row", schema).alias("r")).select("cache_key", "modified", "place", "r.*")
