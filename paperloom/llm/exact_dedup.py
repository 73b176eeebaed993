"""Exact deduplication by a distributed sort of the contents (operator 10, native).

Normalised bytes are range-partitioned by sampled splitters, an external sort places equal texts
side by side in each range, and each row is compared in full with its neighbour. Texts are
shuffled once, and no hash takes part in the order.

The splitters come from a sample of rows drawn by a hash of the identifier. Any byte string can
part a range, so a splitter need only be long enough to tell two sampled texts apart. The driver takes
the first bytes of the sampled texts. Where different texts begin alike and would fill a range, the
length of what they share is found in Spark, and the driver takes that once, and of each text the
bytes after it; so it never holds more than a piece a text, however long the shared beginnings are. A
text that takes up half a range or more by itself, as a large group of copies does, gets ranges of its
own over which its rows are dealt. The heads of the runs there, one a range and text, are then merged by
a second full comparison.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, cut

#: Bytes of text that a range is meant to hold.
RANGE_BYTES = 64 << 20
#: One row in so many is sampled, between the least and most rows of a sample. Four sampled rows a range or more: the
#: greatest sample bounds the number of ranges and what the driver holds, while a range may grow, as its sort spills.
SAMPLE_EVERY, LEAST_SAMPLE, MAX_SAMPLE, ROWS_A_RANGE = 1_000, 10_000, 200_000, 4
#: Bytes that a row has beside its text.
ROW_BYTES = 64
#: Bytes of a sampled text that the driver takes at a time, and bytes that all splitters, and all shared beginnings, may have.
KEY_BYTES, SPLITTER_BYTES = 256, 8 << 20


def _norm(text: Column) -> Column:
    return ascii_lower(text).cast("binary")


def _check(keep: str) -> None:
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")


def _order(keep: str) -> Column:
    return F.col("id").asc_nulls_first() if keep == "min" else F.col("id").desc_nulls_last()


def _extreme(keep: str, over=None) -> Column:
    """The identifier that stays; a null one is the least, which min() would pass over."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return at(F.max("id")) if keep == "max" else F.when(at(F.max(F.col("id").isNull())), F.lit(None)).otherwise(at(F.min("id")))


def _tie(rows: DataFrame) -> list[Column]:
    """Order of rows that text and identifier leave open: their other columns, as text, and the text as it was."""
    return [F.to_json("rest", {"ignoreNullFields": "false"}), F.col("text")] if "rest" in rows.columns else []


def _draw() -> Column:
    return F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("content sort"))


@dataclass
class HotText:
    hash: int
    length: int
    first: int
    ranges: int


@dataclass
class Splitters:
    """Ranges of normalised bytes. Range r holds what is not below cuts[r - 1] and below cuts[r].

    ``hot`` lists the texts whose rows are dealt over ranges of their own.
    """

    cuts: list[bytes] = field(default_factory=list)
    hot: list[HotText] = field(default_factory=list)
    n_ranges: int = 1

    def start(self, text: Column) -> Column:
        """As many normalised bytes of a text as the cuts need."""
        return _norm(F.substring(text, 1, max(map(len, self.cuts), default=0)))

    def place(self, start: Column) -> Column:
        """Number of the range of a text that starts so: cuts not above it, counted among about the square root of all, then in one group."""
        if not self.cuts:
            return F.lit(0)
        step = max(1, int(len(self.cuts) ** 0.5))
        groups = [self.cuts[at : at + step] for at in range(0, len(self.cuts), step)]
        literal = lambda cuts: F.array(*[F.lit(bytearray(c)) for c in cuts])
        not_above = lambda cuts: F.size(F.filter(cuts, lambda c: c <= start))
        group = not_above(literal([g[0] for g in groups]))
        within = not_above(F.get(F.array(*[literal(g) for g in groups]), group - 1))
        return F.when(group == 0, 0).otherwise((group - 1) * step + within).cast("int")

    def place_hot(self, text: Column) -> Column:
        """One of the ranges of a hot text, drawn by the identifier; null for others. Only texts of a hot text's length are hashed."""
        if not self.hot:
            return F.lit(None).cast("int")
        table = F.map_from_arrays(F.array(*[F.lit(h.hash) for h in self.hot]), F.array(*[F.struct(F.lit(h.first).alias("first"), F.lit(h.ranges).alias("n")) for h in self.hot]))
        mine = F.try_element_at(table, F.when(F.coalesce(F.octet_length(text), F.lit(0)).isin(sorted({h.length for h in self.hot})), F.xxhash64(_norm(text))))
        return F.when(mine.isNotNull(), mine["first"] + F.pmod(_draw(), mine["n"]).cast("int"))


@dataclass
class Sample:
    """What the driver holds of the sampled texts: pieces of ``key_bytes`` in groups that begin alike.

    Group 0 holds all texts by their first bytes. Where many different texts share a piece, they are a
    group of their own: ``beginning`` is all that they share, and their pieces are what follows it.
    """

    key_bytes: int = KEY_BYTES
    pieces: dict[int, list[tuple[bytes, int, int]]] = field(default_factory=dict)  # group -> (piece, hash of the whole, length)
    beginning: dict[int, bytes] = field(default_factory=lambda: {0: b""})
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)

    def in_order(self) -> list[tuple[tuple, int, int]]:
        """(path, hash, length) of all texts in order; a path is the (group, piece) of each group from the first on."""
        paths: dict[int, tuple] = {0: ()}
        for (group, piece), below in sorted(self.child.items(), key=lambda x: x[1]):
            paths[below] = (*paths[group], (group, piece))
        return sorted(((*paths[g], (g, piece)), h, n) for g, rows in self.pieces.items() for piece, h, n in rows)

    def cut(self, before: tuple, path: tuple) -> tuple[int, bytes]:
        """The shortest bytes above the text before and not above that of ``path``, as what follows a group's beginning."""
        (group, left), (_, right) = next((x, y) for x, y in zip(before, path) if x != y)
        same = next((k for k, (x, y) in enumerate(zip(left, right)) if x != y), len(left))
        return group, right[: same + 1]


def _shares(sample: Sample, n_ranges: int, splitter_bytes: int) -> tuple[list[bytes], dict[int, int]]:
    """Cuts at equal shares of the sample's bytes, and ranges of the hot texts by hash.

    A text that takes up half a range or more by itself is hot; the others are cut at shares of what
    they hold together. Where the cuts would take more than ``splitter_bytes``, only every second,
    third and so on of those with a beginning stays.
    """
    rows = sample.in_order()
    weight: dict[int, int] = {}
    seen: dict[int, int] = {}
    for _, h, n in rows:
        weight[h] = weight.get(h, 0) + n + ROW_BYTES
        seen[h] = seen.get(h, 0) + 1
    full = max(1.0, sum(weight.values()) / n_ranges)
    hot = {h: int(w / full) + 1 for h, w in weight.items() if seen[h] > 1 and 2 * w >= full}
    places: list[tuple[int, bytes]] = []
    held, before = 0, None
    for path, h, n in rows:
        if h in hot:
            continue
        if held >= full and path != before:
            places.append(sample.cut(before, path))
            held = 0
        held, before = held + n + ROW_BYTES, path
    long = [k for k, (group, _) in enumerate(places) if group]
    spent = sum(len(sample.beginning[places[k][0]]) + len(places[k][1]) for k in long)
    every = max(1, -(-spent // splitter_bytes))
    left_out = {k for i, k in enumerate(long) if i % every}
    return [sample.beginning[group] + rest for k, (group, rest) in enumerate(places) if k not in left_out], hot


def _unclear(sample: Sample, groups: list[int], n_ranges: int, hot: dict[int, int]) -> list[tuple[int, bytes]]:
    """Pieces of the given groups that different texts share which together fill a range or more, the fullest first."""
    full = sum(n + ROW_BYTES for rows in sample.pieces.values() for _, _, n in rows) / n_ranges
    held: dict[tuple[int, bytes], int] = {}
    hashes: dict[tuple[int, bytes], set[int]] = {}
    for group in groups:
        for piece, h, n in sample.pieces.get(group, []):
            if len(piece) >= sample.key_bytes and h not in hot:
                held[group, piece] = held.get((group, piece), 0) + n + ROW_BYTES
                hashes.setdefault((group, piece), set()).add(h)
    return sorted((k for k, w in held.items() if len(hashes[k]) > 1 and w >= full), key=lambda k: (-held[k], k))


def _shared_length(a: Column, b: Column) -> Column:
    """Bytes that two binary values begin with alike, by halving."""
    ends = F.struct(F.lit(0).alias("low"), F.least(F.octet_length(a), F.octet_length(b)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(mid - 1).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), ends, halve)["low"]


def find_splitters(rows: DataFrame, range_bytes: int = RANGE_BYTES, max_sample: int = MAX_SAMPLE, key_bytes: int = KEY_BYTES, splitter_bytes: int = SPLITTER_BYTES) -> Splitters:
    """Splitters of rows (id, text), from one scan of the texts.

    At least spark.sql.shuffle.partitions ranges. The driver holds a piece of ``key_bytes`` for up to about
    ``max_sample`` texts, and at most ``splitter_bytes`` of shared beginnings.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows = rows.select(F.lit(1)).count()  # from the footers, without the texts
    if not n_rows:
        return Splitters()
    share = min(1.0, min(max_sample, max(LEAST_SAMPLE, ROWS_A_RANGE * least, n_rows // SAMPLE_EVERY)) / n_rows)
    drawn = F.pmod(_draw(), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    norm = _norm(F.col("text"))
    level = cut(rows.filter(drawn).select(F.lit(0).alias("group"), F.lit(0).alias("shared"), norm.alias("norm"), F.xxhash64(norm).alias("h"), F.octet_length("text").cast("long").alias("n")))
    piece = F.substring("norm", F.col("shared") + 1, F.lit(key_bytes))
    sample = Sample(key_bytes)

    def take() -> list[int]:
        """Pieces of the level's texts; the groups met."""
        groups: dict[int, list] = {}
        for r in level.select("group", piece.alias("piece"), "h", "n").collect():
            groups.setdefault(r["group"], []).append((bytes(r["piece"]), r["h"], r["n"] or 0))
        sample.pieces.update(groups)
        return list(groups)

    groups = take()
    held = sample.pieces.get(0)
    if not held:
        return Splitters()
    n_ranges = max(least, min(len(held) // ROWS_A_RANGE, int(sum(n for *_, n in held) / len(held) * n_rows / range_bytes)))
    cuts, hot = _shares(sample, n_ranges, splitter_bytes)
    while unclear := _unclear(sample, groups, n_ranges, hot):
        numbers = {k: len(sample.beginning) + i for i, k in enumerate(unclear)}
        table = spark.createDataFrame([(g, bytearray(p), i) for (g, p), i in numbers.items()], "group int, piece binary, below int")
        inside = level.withColumn("piece", piece).join(F.broadcast(table), ["group", "piece"]).drop("group", "piece", "shared").withColumnRenamed("below", "group")
        lengths = cut(inside.groupBy("group").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).withColumn("shared", _shared_length(F.col("a"), F.col("b"))))
        left = splitter_bytes - sum(map(len, sample.beginning.values()))
        known = {}
        for i, n in sorted((r["group"], r["shared"]) for r in lengths.select("group", "shared").collect()):
            if n <= left:  # the fullest first; what does not fit stays one piece
                known[i], left = n, left - n
        if not known:
            break
        fits = F.col("group").isin(list(known))
        sample.beginning.update({r["group"]: bytes(r["beginning"]) for r in lengths.filter(fits).select("group", F.substring("a", F.lit(1), F.col("shared")).alias("beginning")).collect()})
        sample.child.update({k: i for k, i in numbers.items() if i in known})
        level = cut(inside.filter(fits).join(F.broadcast(lengths.filter(fits).select("group", "shared")), "group").select("group", "shared", "norm", "h", "n"))
        groups = take()
        sample.pieces = {g: [x for x in p if (g, x[0]) not in sample.child] for g, p in sample.pieces.items()}
        cuts, hot = _shares(sample, n_ranges, splitter_bytes)
    out = Splitters(cuts, n_ranges=len(cuts) + 1)
    length = {h: n for p in sample.pieces.values() for _, h, n in p}
    for h, n in sorted(hot.items()):
        out.hot.append(HotText(h, length[h], out.n_ranges, n))
        out.n_ranges += n
    return out


def _sorted_runs(rows: DataFrame, splitters: Splitters, keep: str) -> DataFrame:
    """Rows (id, text, ...) in their ranges, with range, norm, head (first of a run of equal texts) and run (its number in the range)."""
    placed = rows.withColumn("start", splitters.start(F.col("text"))).withColumn("range", F.coalesce(splitters.place_hot(F.col("text")), splitters.place(F.col("start")))).drop("start")
    # the normalised bytes are made after the shuffle, which moves the text alone
    ranged = placed.repartitionById(splitters.n_ranges, "range").withColumn("norm", _norm(F.col("text")))
    beside = Window.partitionBy("range").orderBy("norm", _order(keep), *_tie(rows))
    before = F.lag("norm").over(beside)
    return ranged.withColumn("head", before.isNull() | (before != F.col("norm"))).withColumn("run", F.sum(F.col("head").cast("long")).over(beside.rowsBetween(Window.unboundedPreceding, 0)))


def _first_hot(splitters: Splitters) -> int:
    return splitters.hot[0].first if splitters.hot else splitters.n_ranges


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **ranges) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names the row that stays, that
    with the smallest ("min") or largest ("max") identifier. Null text counts as empty. A null
    identifier is smaller than any other. Of rows with the same text and identifier one stays.
    An empty table gives no rows. Other columns are ignored. ``ranges``: see find_splitters.
    """
    _check(keep)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    splitters = find_splitters(rows, **ranges)
    in_hot = F.col("range") >= _first_hot(splitters)
    runs = _sorted_runs(rows, splitters, keep).select("id", "range", "run", "head", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("head") & in_hot, F.col("norm")).alias("hot_norm"))
    within = Window.partitionBy("range", "run")
    grouped = runs.select("id", "range", "run", "head", "text_sha256", "hot_norm", _extreme(keep, within).alias("keep_id"), F.count(F.lit(1)).over(within).alias("group_size"))
    if splitters.hot:
        grouped = cut(grouped)
        heads = grouped.filter(F.col("hot_norm").isNotNull()).select(F.col("keep_id").alias("id"), "range", "run", "group_size", "hot_norm")
        same = Window.partitionBy("hot_norm")
        # one row a hot range, but for texts that share a hot one's 64-bit hash
        merged = heads.select("range", "run", _extreme(keep, same).alias("all_keep"), F.sum("group_size").over(same).alias("all_size"))
        grouped = (
            grouped.drop("hot_norm")
            .join(F.broadcast(merged), ["range", "run"], "left")
            .withColumn("keep_id", F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")))
            .withColumn("group_size", F.coalesce("all_size", "group_size"))
        )
    # rows that repeat a hot text's identifier fall into one range, as they draw alike: one of them is a head
    stays = F.col("head") & F.col("id").eqNullSafe(F.col("keep_id"))
    return grouped.select(F.col("id").alias(id_col), F.col("keep_id"), F.col("group_size"), stays.alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **ranges) -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns, straight out of the sort: no join by identifier.

    Defined on odd rows as exact_dedup is. Of rows with the same identifier and text the one stays whose
    other columns come first as text, and then whose text before lower-casing does; so the same rows in
    any order give the same table.
    """
    _check(keep)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    splitters = find_splitters(rows.select("id", "text"), **ranges)
    heads = _sorted_runs(rows, splitters, keep).filter("head")
    columns = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns]
    if not splitters.hot:
        return heads.select(*columns)
    # the heads of hot ranges, one a range and text, meet by their whole text
    cold = heads.filter(F.col("range") < _first_hot(splitters))
    hot = heads.filter(F.col("range") >= _first_hot(splitters))
    best = Window.partitionBy("norm").orderBy(_order(keep), *_tie(rows))
    hot = hot.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return cold.select(*columns).union(hot.select(*columns))
