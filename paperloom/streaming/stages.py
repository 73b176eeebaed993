"""Stateless document stages on a stream, and progress events of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.classify import classify_by_keywords


def sentence_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Gate, sentences and filters; the same for a table and for a stream, as no state is kept."""
    kept = docs.filter(T.looks_english(F.col(text_col)))
    return kept.select(id_col, F.posexplode(T.kept_sentences(F.col(text_col))).alias("pos", "text"))


def keyword_stage(sentences: DataFrame) -> DataFrame:
    """Keyword labels of a stream's sentences."""
    return classify_by_keywords(sentences)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder as a stream; files that arrive are read once, in place of a cache by modification time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def progress_rows(done: DataFrame, phase: str, total: int, order: str = "step", *others: str) -> DataFrame:
    """(phase, completed, total, remaining, others) of each finished step, in order."""
    return done.select(F.lit(phase).alias("phase"), F.col(order).alias("completed"), F.lit(total).alias("total"), F.greatest(F.lit(total) - F.col(order), F.lit(0)).alias("remaining"), *others)


def write_progress(stream: DataFrame, path: str, checkpoint: str, phase: str, total: int):
    """NDJSON events of each micro-batch: progress, and with the last one of ``total`` the result; an error event where a batch fails.

    A batch that is replayed writes its own folder again.
    """

    def write(events: DataFrame, epoch: int) -> None:
        events.coalesce(1).write.mode("overwrite").json(f"{path}/epoch={epoch}")

    def note(batch: DataFrame, epoch: int) -> None:
        try:
            step = batch.agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(epoch + 1))
            done = progress_rows(step, phase, total, "step", "rows").withColumn("type", F.lit("progress"))
            result = F.when(F.col("remaining") == 0, F.array(F.lit("progress"), F.lit("result"))).otherwise(F.array(F.lit("progress")))
            write(done.withColumn("type", F.explode(result)), epoch)
        except Exception as e:
            write(batch.sparkSession.createDataFrame([("error", phase, str(e)[:300])], "type string, phase string, message string"), epoch)
            raise

    return stream.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: events by type and hour with a watermark; ts is brought to a zoned timestamp first."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
