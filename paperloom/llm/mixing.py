"""Mixing sources to target weights (operator 5) by Sainte-Lague apportionment.

Words are dealt in blocks of equal length. Blocks go to sources by the highest quotients of their
targets, and a source's blocks to its shards by the highest quotients of the shards' words: integer
quotas. Within a shard, documents stand in a seeded order and their words form one stream of
blocks. A quota of q of the n blocks takes every block q div n times, and the q mod n blocks with
the smallest seeded hashes once more.

The level of the targets and the divisor of the quotas are numbers found by searches whose steps
are aggregates over the table of sources, so there may be any number of these. A hot source is
many shards, so no window over a shard holds a large part of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, ship

#: Points at which a step of a search evaluates its sums, and quantiles of sources that a step of the level's search takes.
GRID, STEP_POINTS = 48, 256
#: Bytes of sources that are broadcast, bytes of a source beside its name, and salts of their join beyond.
MAX_BROADCAST, SOURCE_BYTES, SALTS = 20_000_000, 80, 16


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1), at most ``caps`` each; ties go to the first."""
    votes, caps = votes.astype(float), caps.astype(np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    above = lambda d: np.where(votes > 0, np.minimum(caps, np.maximum(np.ceil(votes / d - 0.5), 0)), 0).astype(np.int64)  # noqa: E731  seats with a quotient above d / 2
    low, high = 0.0, 4 * votes.max()
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if above(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    out = above(high)
    while (rest := seats - int(out.sum())) > 0:
        quotient = np.where((out < caps) & (votes > 0), votes / (2 * out + 1), -1.0)
        order = np.argsort(-quotient, kind="stable")[:rest]
        out[order] += quotient[order] >= 0
    return out


def fill_level(sources: DataFrame, total: float) -> float:
    """Level at which targets least(cap, level * weight) add up to ``total``; infinity where all caps do not reach it.

    ``sources`` has columns cap (long) and weight. A step splits the sources still in question at
    STEP_POINTS of their own levels, so up to so many sources are told apart by one step.
    """
    sums = [F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))]
    count, caps, weight = sources.agg(*sums).first()
    if not count or not weight or caps <= total:
        return float("inf")
    reached = F.col("cap") / F.col("weight")  # the level at which a source is full
    full, low = (0, 0, 0.0), 0.0  # sources full at the level low: their number, caps and weights
    inside = sources.withColumn("reached", reached)
    while True:
        points = inside.agg(F.array_sort(F.array_distinct(F.percentile_approx("reached", [k / STEP_POINTS for k in range(1, STEP_POINTS + 1)], 100 * STEP_POINTS)))).first()[0] or []
        at = F.size(F.filter(F.array(*map(F.lit, points)), lambda x: x < F.col("reached")))  # points below a source's level
        parts = {r["at"]: tuple(r[k] for k in (1, 2, 3)) for r in inside.groupBy(at.alias("at")).agg(*sums).collect()}
        high = None
        for k, x in enumerate(points):
            more = tuple(a + b for a, b in zip(full, parts.get(k, (0, 0, 0.0))))
            if more[1] + x * (weight - more[2]) > total:
                high = x
                break
            full, low = more, x
        left = inside.filter((F.col("reached") > low) & (F.col("reached") < high)) if high is not None else None
        if left is None or left.isEmpty():
            _, filled, of_filled = full
            return (total - filled) / (weight - of_filled) if weight > of_filled else low
        inside = left


def seat_counts(parties: DataFrame, seats: int) -> DataFrame:
    """Adds the column quota to (number, votes, cap, ...): Sainte-Lague seats, at most ``cap``; ties go to the smaller number.

    With V votes, S seats and n parties, rounding moves the divisor by no more than V / (S - n / 2),
    and caps only lower it. Steps of GRID points close in on it: at first by distances from this
    bound that double, then evenly.
    """
    above = lambda d: F.when(F.col("votes") > 0, F.least(F.col("cap"), F.greatest(F.ceil(F.col("votes") / d - 0.5), F.lit(0)))).otherwise(F.lit(0)).cast("long")
    most, all_caps, votes, n = parties.filter("votes > 0").agg(F.max("votes"), F.sum("cap"), F.sum("votes"), F.count(F.lit(1))).first()
    seats = min(seats, all_caps or 0)
    if seats <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    low, given = 0.0, -1
    high = min(4 * most, votes / (seats - n / 2) * (1 + 1e-9)) if seats > n / 2 else 4 * most
    grid = [high * (1 - 2.0**-k) for k in range(GRID // 2, 0, -1)] + [high * 2.0**-k for k in range(2, GRID // 2)] + [high]
    while given != seats and (grid := sorted({x for x in grid if low < x <= high})):
        points = parties.select("votes", "cap", F.explode(F.array(*map(F.lit, grid))).alias("d"))
        sums = {r["d"]: r["n"] for r in points.groupBy("d").agg(F.sum(above(F.col("d"))).alias("n")).collect()}
        high, given = min([(d, k) for d, k in sums.items() if k <= seats], default=(high, given))
        low = max([d for d, k in sums.items() if k > seats], default=low)
        grid = [x for k in range(1, GRID + 1) if low < (x := low + (high - low) * k / (GRID + 1)) < high]
    quota = parties.withColumn("quota", above(high))
    if given == seats or not low:
        return quota
    # quotients equal to the last bit: one seat more for the first of these
    rest = seats - quota.agg(F.sum("quota")).first()[0]
    tied = quota.filter(above(low) > F.col("quota")).orderBy("number").limit(int(rest)).select("number", F.lit(1).cast("long").alias("one"))
    return quota.join(tied, "number", "left").withColumn("quota", F.col("quota") + F.coalesce("one", F.lit(0))).drop("one")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(rows: DataFrame) -> DataFrame:
    """(name, source_size, number) of rows (source, size): number from 0 in code-point order, null last."""
    sizes = rows.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size"))
    placed = cut(sizes.repartitionByRange(F.col("name").asc_nulls_last()).sortWithinPartitions(F.col("name").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    # the id holds the range's number above 33 bits of places; the driver sees a count a range
    of = F.shiftright("at", 33)
    counts = sorted(placed.groupBy(of.alias("range")).count().collect())
    before, offsets = 0, {}
    for r, n in counts:
        offsets[r], before = before, before + n
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]), of) if offsets else F.lit(0).cast("long")
    return placed.select("name", "source_size", (first + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = 64, shard_words: int = 2_000_000, seed: int = 17) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    Sources in code-point order, null last, have ``weights``, repeated. ``taken`` counts the words
    the mix takes of a document, repeats included, never above ``most`` (a whole number) times its
    size. Null text has no words. A source without words has target 0. The same rows give the same
    mix in every run; repeated rows share their takings in either order; rows without an identifier
    draw by their text. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    # rows without an identifier draw by their text
    mark = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.xxhash64(F.col(text_col)).cast("string")))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), mark).alias("draw"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = cut(numbered_sources(rows).withColumns({"weight": weight, "cap": most * F.col("source_size"), "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int")}))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = fill_level(sources, total)
    targets = sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level) if level != float("inf") else F.col("cap").cast("double"))
    shard = F.pmod(F.xxhash64(F.col("draw"), F.lit(1)), F.col("shards")).cast("int")
    few = (sources.agg(F.sum(SOURCE_BYTES + F.coalesce(F.octet_length("name"), F.lit(0)))).first()[0] or 0) <= MAX_BROADCAST
    if few:
        met = rows.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("name")))
    else:  # a hot source's rows are dealt over salts
        salted = rows.withColumn("salt", F.pmod("draw", F.lit(SALTS)).cast("int"))
        met = salted.join(targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("salt", "of"), F.col("source").eqNullSafe(F.col("name")) & (F.col("salt") == F.col("of")))
    dealt = met.select("id", "size", "source_size", "target", "number", "draw", shard.alias("shard"))

    shards = cut(dealt.groupBy("number", "shard").agg(F.sum("size").alias("words")).withColumn("n", F.ceil(F.col("words") / block_words).cast("long")))
    parties = targets.select("number", F.col("target").alias("votes")).join(shards.groupBy("number").agg((most * F.sum("n")).alias("cap")), "number")
    quotas = seat_counts(cut(parties), round((targets.agg(F.sum("target")).first()[0] or 0.0) / block_words))

    def of_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        """Quotas of one source's shards, each of which stands for ``shard_words`` words."""
        pdf = pdf.sort_values("shard")
        n = pdf["n"].to_numpy()
        given = sainte_lague(pdf["words"].to_numpy(), int(pdf["quota"].iloc[0]), most * n)
        return pd.DataFrame({"number": pdf["number"], "shard": pdf["shard"], "times": given // np.maximum(n, 1), "more": np.where(n > 0, given % np.maximum(n, 1), 0), "n": n})

    given = shards.join(quotas.select("number", "quota"), "number").groupBy("number").applyInPandas(of_shards, "number long, shard int, times long, more long, n long")
    # blocks of a shard up to the hash of the last chosen one are taken once more
    hash_of = lambda b: F.xxhash64(F.lit(seed), F.col("number"), F.col("shard"), b.cast("long"))
    last = F.when(F.col("more") > 0, F.element_at(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), hash_of)), F.col("more").cast("int")))
    plan = given.withColumn("last", last).drop("n")

    stream = Window.partitionBy("number", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("stop", F.sum("size").over(stream)).join(plan, ["number", "shard"])
    start = F.col("stop") - F.col("size")
    block = lambda b: F.least(F.col("stop"), (b + 1) * block_words) - F.greatest(start, b * block_words)
    none = F.lit(0).cast("long")
    extra = F.aggregate(F.sequence(F.floor(start / block_words), F.floor((F.col("stop") - 1) / block_words)), none, lambda held, b: held + F.when(hash_of(b) <= F.col("last"), block(b)).otherwise(none))
    taken = F.when(F.col("size") == 0, none).otherwise(F.col("times") * F.col("size") + F.when(F.col("more") > 0, extra).otherwise(none))
    return laid.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def whole_copies(taken: Column, size: Column, id_col: Column, seed: int = 17) -> Column:
    """Copies of a whole document that stand for the words taken of it: the ratio, rounded up or down by a seeded draw."""
    u = F.pmod(F.xxhash64(F.lit(seed), id_col.cast("string"), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.when(size > 0, F.floor(taken / size + u)).otherwise(F.lit(0)).cast("int")
