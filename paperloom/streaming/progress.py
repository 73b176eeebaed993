"""Progress events of models, in order, and a sink that writes none twice.

Outcomes of a model's steps may come in any order and over several micro-batches. State holds those
that are ahead of their turn, so events leave in order: a start, two events a step, and then one event
that ends the model, a result or an error; what comes after that is left out.

The sink is a Python data source. Tasks write their events to files of their own (first phase); the
driver then names these files in one manifest for the batch (second phase), and only named files are
read. A batch that is run again after its manifest was written leaves that as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship
from .cache import state_provider

# --- fixed values: the events' wording --------------------------------------------------------------
MESSAGES = {
    "start": "Scoring {total} checklist sections.",
    "begin": "Scoring section {index}/{total}: {section} ({left} remaining).",
    "end": "Finished section {index}/{total}: {section} ({left} remaining).",
    "error": "Scoring failed at section {index}/{total}: {section} ({error}).",
    "complete": "Scoring complete.",
}
ERROR_CHARS = 300
EVENT = "key string, seq long, type string, phase string, stage string, section string, completed long, total long, remaining long, message string"
MANIFESTS, PARTS = "_manifests", "parts"


def event(key: str, seq: int, phase: str, stage: str, index: int, total: int, section: str | None = None, error: str | None = None) -> dict:
    """One event; ``index`` counts from 1 and is 0 for the start."""
    done = {"start": 0, "begin": index - 1, "error": index - 1, "complete": total, "result": total, "failed": index - 1}.get(stage, index)
    kind = {"result": "result", "failed": "error"}.get(stage, "progress")
    text = error if stage == "failed" else MESSAGES.get(stage, "").format(total=total, index=index, section=section, left=max(total - done, 0), error=(error or "")[:ERROR_CHARS])
    return {"key": key, "seq": seq, "type": kind, "phase": phase, "stage": stage, "section": section, "completed": done, "total": total, "remaining": max(total - done, 0), "message": text}


STATE = "next int, seq long, ended boolean, ahead string"


def _in_order(key: str, came: dict[int, tuple], total: int, held: tuple, phase: str) -> tuple[list[dict], tuple]:
    """Events that a batch's outcomes (section, error) by step let go, and what is held afterwards: next step, seq, end, and as JSON what is ahead."""
    following, seq, ended, kept = held
    ahead = {int(k): tuple(v) for k, v in json.loads(kept or "{}").items()}
    out: list[dict] = []

    def tell(stage: str, *more) -> None:
        nonlocal seq
        seq += 1
        out.append(event(key, seq, phase, stage, following, total, *more))

    if following == 0:
        tell("start")
        following = 1
    while following <= total:
        got = came.get(following, ahead.pop(following, None))
        if got is None:
            break
        section, error = got
        tell("begin", section)
        if error is not None:
            tell("error", section, error)
            tell("failed", section, error)
            ended = True
            break
        tell("end", section)
        following += 1
    if not ended and following > total:
        following = total
        tell("complete")
        tell("result")
        ended = True
    ahead = {} if ended else {k: v for k, v in came.items() if k > following} | ahead
    return out, (following, seq, ended, json.dumps(ahead, ensure_ascii=False) if ahead else None)


def ordered_events(steps: DataFrame, key: Column, phase: str = "scoring") -> DataFrame:
    """EVENT rows of a stream (step from 1, section, error, total) by key, in order of seq within a key.

    A step that comes twice counts once, as first come; steps under 1 or over ``total`` are left out, as
    are rows without a key. A key without steps (total 0) starts and ends. State goes to Python and back
    with the rows, many keys a batch, so what a key holds ahead is written anew whenever it gets rows; a
    key's events are one value there, and rows after it.
    """
    ship(steps.sparkSession)

    def turns(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, False, None)
        if held[2]:
            return
        came: dict[int, tuple] = {}
        total = 0
        for pdf in batches:
            for row in pdf["outcome"]:
                step, section, error, n = json.loads(row)
                came.setdefault(int(step), (section, error))
                total = int(n)
        out, held = _in_order(of[0], came, total, held, phase)
        state.update(held)
        if out:
            yield pd.DataFrame({"events": [json.dumps(out, ensure_ascii=False)]})

    outcome = F.to_json(F.array(F.col("step").cast("int").cast("string"), F.col("section").cast("string"), F.col("error").cast("string"), F.col("total").cast("int").cast("string")))
    told = steps.filter(F.col("step").cast("int").isNotNull() & F.col("total").cast("int").isNotNull()).select(key.cast("string").alias("key"), outcome.alias("outcome")).filter("key is not null")
    events = told.groupBy("key").applyInPandasWithState(turns, "events string", STATE, "append", GroupStateTimeout.NoTimeout)
    return events.select(F.explode(F.from_json("events", f"array<struct<{EVENT}>>", {"mode": "FAILFAST"})).alias("e")).select("e.*")


class EventWriter(DataSourceStreamWriter):
    """Two phases: files of tasks, then a manifest for the batch."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns

    def _at(self, *below: str):
        uri = self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}"
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        return fs, "/".join([root, *below])

    def write(self, rows) -> WriterCommitMessage:
        """One file a task, its events by key and seq; nothing reads it before the batch is committed."""
        name = f"{uuid.uuid4().hex}.json"
        held = sorted((r.asDict() for r in rows), key=lambda r: (r.get("key") or "", r.get("seq") or 0))
        if not held:
            return EventFile("", 0)
        fs, folder = self._at(PARTS)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as f:
            for r in held:
                f.write((json.dumps(r, ensure_ascii=False, default=str) + "\n").encode())
        return EventFile(name, len(held))

    def commit(self, messages: list, batchId: int) -> None:
        """Names the batch's files at once: the manifest is written aside and moved. A batch that has one keeps it."""
        fs, folder = self._at(MANIFESTS)
        fs.create_dir(folder, recursive=True)
        target = f"{folder}/{batchId:012d}.json"
        files = [m.name for m in messages if m is not None and m.name]
        if fs.get_file_info(target).type != pyarrow.fs.FileType.NotFound:
            self._drop(files)
            return
        aside = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps(files).encode())
        fs.move(aside, target)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop([m.name for m in messages if m is not None and m.name])

    def _drop(self, files: list[str]) -> None:
        for name in files:
            fs, at = self._at(PARTS, name)
            if fs.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(at)


class EventFile(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class EventSource(DataSource):
    """Format ``ordered_events``: option path, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "ordered_events"

    def streamWriter(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"], schema.fieldNames())


def write_events(events: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in all that has come and appends its events to the folder ``path``; a restart goes on from its checkpoint."""
    spark = events.sparkSession
    ship(spark)
    spark.dataSource.register(EventSource)
    with state_provider(spark):
        events.writeStream.format("ordered_events").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The committed events with the number of their batch. Manifests are read by Spark, so there may be many."""
    named = spark.read.schema("value string").text(f"{path}/{MANIFESTS}/*.json")
    files = named.select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long").alias("batch"), F.explode(F.from_json("value", "array<string>")).alias("name"))
    lines = spark.read.text(f"{path}/{PARTS}/*.json").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.from_json("value", EVENT).alias("e"))
    return lines.join(files, "name").select("batch", "e.*")
