"""Calls to services outside of the cluster: once a request, with a deadline, retries and an error column.

Requests are told apart by a digest of their text. Those that a store does not hold yet are dealt over
tasks, asked a bounded number at a time, and appended to the store, a Parquet folder; plans read the
store, so however often a plan needs an answer, the service is asked once. A task that is lost and run
again asks again what it had not committed.
"""

from __future__ import annotations

import heapq
import json
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import folder_exists, working_folder
from ..shipping import ship

TIMED_OUT = "call timed out"
ROW = "request_id string, answer string, error string, attempts int"


class Refused(Exception):
    """Raised by a call that need not be tried again."""


class TooManyStalled(RuntimeError):
    """More calls of a task stand still than it may leave behind."""


@dataclass(frozen=True)
class CallPolicy:
    """How a service is asked.

    An attempt that takes more than ``seconds`` is given up. After a failure the request waits
    ``wait`` seconds, then twice as long and so on, and is tried ``attempts`` times in all. A task has
    ``at_once`` calls under way. Python cannot end a thread, so a call given up goes on until it
    returns, its answer unread; a task in which more than ``most_stalled`` such calls stand fails.
    """

    seconds: float = 15.0
    attempts: int = 2
    wait: float = 1.0
    at_once: int = 8
    most_stalled: int = 1_000

    def __post_init__(self):
        if self.seconds <= 0 or self.attempts < 1 or self.wait < 0 or self.at_once < 1 or self.most_stalled < 0:
            raise ValueError("seconds, attempts and at_once are positive, wait and most_stalled not negative")


def ask_all(call: Callable[[str], object], requests: list[str], policy: CallPolicy) -> list[tuple[str | None, str | None, int]]:
    """(answer, error, attempts) of each request, in their order.

    The calls run in threads; this one starts them, as many as may be under way, and waits for the
    next answer, deadline or retry. An answer that comes after its deadline is not read.
    """
    out: list[tuple[str | None, str | None, int]] = [(None, TIMED_OUT, 0)] * len(requests)
    waiting = [(0.0, k, 1) for k in range(len(requests))]  # (ready from, request, attempt): in order, so a heap
    came: queue.SimpleQueue[tuple[int, object, Exception | None]] = queue.SimpleQueue()
    running: dict[int, tuple[int, int, float]] = {}  # call -> request, attempt, deadline
    stalled: set[int] = set()
    calls = 0

    def one(number: int, request: str) -> None:
        try:
            came.put((number, call(request), None))
        except Exception as e:  # noqa: BLE001  any failure of a service is a result
            came.put((number, None, e))

    def failed(k: int, attempt: int, error: str, final: bool) -> None:
        if final or attempt >= policy.attempts:
            out[k] = (None, error, attempt)
        else:
            heapq.heappush(waiting, (time.monotonic() + policy.wait * 2 ** (attempt - 1), k, attempt + 1))

    while waiting or running:
        now = time.monotonic()
        while waiting and len(running) < policy.at_once and waiting[0][0] <= now:
            _, k, attempt = heapq.heappop(waiting)
            running[calls] = (k, attempt, now + policy.seconds)
            threading.Thread(target=one, args=(calls, requests[k]), daemon=True).start()
            calls += 1
        ends = [d for _, _, d in running.values()] + ([waiting[0][0]] if waiting and len(running) < policy.at_once else [])
        try:
            number, answer, error = came.get(timeout=max(0.0, min(ends) - time.monotonic()))
            stalled.discard(number)
            if number in running:
                k, attempt, _ = running.pop(number)
                if error is not None:
                    failed(k, attempt, f"{type(error).__name__}: {error}", isinstance(error, Refused))
                else:
                    out[k] = (answer if answer is None or isinstance(answer, str) else json.dumps(answer, ensure_ascii=False), None, attempt)
        except queue.Empty:
            now = time.monotonic()
            for number in [n for n, (_, _, d) in running.items() if d <= now]:
                k, attempt, _ = running.pop(number)
                stalled.add(number)
                failed(k, attempt, TIMED_OUT, False)
            if len(stalled) > policy.most_stalled:
                raise TooManyStalled(f"{len(stalled)} calls stand still") from None
    return out


def request_id(request: Column) -> Column:
    """Digest that tells requests apart; a null request has none and is never asked."""
    return F.sha2(request.cast("binary"), 256)


def answer_once(requests: DataFrame, call: Callable[[str], object], policy: CallPolicy | None = None, by: str = "request", store: str | None = None, ask_failed_again: bool = False, tasks: int | None = None) -> DataFrame:
    """(request_id, answer, error, attempts) of each different text in the column ``by``.

    ``call`` maps a request to an answer: text, nothing, or what becomes JSON. Exceptions and passed
    deadlines are errors once the attempts are used up; an exception of the kind Refused at once.
    ``store`` is a folder that keeps answers from run to run, by default a new one under the shared
    checkpoint folder. What it holds is not asked again, but for errors where ``ask_failed_again``.
    The requests of one run are dealt over ``tasks`` tasks, spark.sql.shuffle.partitions by default.
    Null requests are left out; empty ones are asked; equal ones are asked once; an empty table asks
    nothing.
    """
    spark, policy = requests.sparkSession, policy or CallPolicy()
    ship(spark)
    store = store or working_folder(spark, "calls")
    texts = requests.select(F.col(by).cast("string").alias("request")).filter("request is not null")
    asked = texts.withColumn("request_id", request_id(F.col("request"))).groupBy("request_id").agg(F.first("request").alias("request"))
    if folder_exists(spark, store):
        held = _last(spark.read.schema(f"{ROW}, run long").parquet(store))
        asked = asked.join((held.filter("error is null") if ask_failed_again else held).select("request_id"), "request_id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = ask_all(call, batch.column(1).to_pylist(), policy)
            answers, errors, attempts = zip(*told) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(attempts, pa.int32())], names=["request_id", "answer", "error", "attempts"])

    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by number, so that no adaptive step puts requests that wait for a service into one task
    dealt = asked.select("request_id", "request").repartition(n, "request_id")
    dealt.mapInArrow(run, ROW).withColumn("run", F.lit(time.time_ns())).write.mode("append").parquet(store)
    return _last(spark.read.schema(f"{ROW}, run long").parquet(store))


def _last(stored: DataFrame) -> DataFrame:
    """One row a request: an answer rather than an error, then the latest."""
    best = F.max_by(F.struct("answer", "error", "attempts"), F.struct(F.col("error").isNull(), F.col("run")))
    return stored.groupBy("request_id").agg(best.alias("r")).select("request_id", "r.*")


def with_answers(rows: DataFrame, call: Callable[[str], object], policy: CallPolicy | None = None, by: str = "prompt", **store) -> DataFrame:
    """Adds answer, error and attempts to each row by its column ``by``; rows without a request keep nulls. ``store``: see answer_once.

    A request that many rows share is joined by its digest; adaptive execution splits such a key.
    """
    told = answer_once(rows, call, policy, by, **store)
    return rows.withColumn("_id", request_id(F.col(by).cast("string"))).join(told.withColumnRenamed("request_id", "_id"), "_id", "left").drop("_id")


@dataclass(frozen=True)
class Service:
    """A callable outside of the cluster, how to ask it, and where its answers are kept."""

    call: Callable[[str], object]
    policy: CallPolicy = CallPolicy()
    store: str | None = None

    def answers(self, rows: DataFrame, by: str = "prompt") -> DataFrame:
        return with_answers(rows, self.call, self.policy, by, store=self.store)
