"""SimHash near-duplicates with Golay-code fuzzy keys (operator 4).

A fingerprint's 64 bits form three segments of 22, 21 and 21 bits, each seen as a word of the
perfect [23, 12, 7] Golay code. Every word lies within 3 bits of one codeword, its home; the
codewords within 4 bits are its keys: 6 of them (1,771 of 2,048 cosets) or the home alone. Of two
words that differ in at most one bit, each one's home is among the other's keys: the home lies
within 3 + 1 bits of the other word.

Three differing bits fall on the segments as (0, x, y) with one of x, y at most 1, or as (1, 1, 1):

* one segment equal and another within one bit: six tables keyed (segment, key of another), and
* all within one bit: one table keyed by three codewords, for which one side lists (home, keys,
  home) and the other (keys, home, keys), so that both hold (home, home', home) of the pair.

So every linked pair meets in a bucket. A key has 33 bits or more, so chance meetings stay few.
Fingerprints that equal each other are one row throughout. Within a bucket, distances are verified
in numpy and only a spanning forest of the links leaves it, not the pairs. A bucket of more than
``max_bucket`` fingerprints is not held: its members go on to an exact linear join instead, in
which two fingerprints within 3 bits share a hub within 1 bit of one and 2 of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, salted_join, text_column_udf
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Generator polynomial of the Golay code: a fixed value.
GOLAY = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (shift, bits)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text, unsigned; 0 for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle_words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text column as a signed long."""

    def make():
        def run(texts: list[str | None]) -> dict[str, list]:
            return {"fp": np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64).tolist()}

        return run

    return text_column_udf("fp long", make)(text)["fp"]


class Golay:
    """Home and keys of 23-bit words, as indices 0..4095 of codewords, with tables built from the rule."""

    def __init__(self):
        low, high = np.arange(1 << 12), np.arange(1 << 11) << 12
        self.low, self.high = self._rest(low), self._rest(high)
        self.errors = np.zeros((2048, 6), np.int64)  # for each syndrome: error patterns of weight up to 3, then of weight 4
        self.n = np.zeros(2048, np.int64)
        for weight in range(5):
            for places in combinations(range(23), weight):
                e = sum(1 << p for p in places)
                s = int(self.syndrome(np.array([e]))[0])
                if weight < 4 or self.n[s] and bin(int(self.errors[s, 0])).count("1") == 3:
                    self.errors[s, self.n[s]] = e
                    self.n[s] += 1

    @staticmethod
    def _rest(words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for bit in range(22, 10, -1):
            out ^= np.where(out >> bit & 1, GOLAY << (bit - 11), 0)
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def home(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[self.syndrome(words), 0]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and keys, one entry for each key of each word."""
        s = self.syndrome(words)
        row, k = np.nonzero(np.arange(6) < self.n[s][:, None])
        return row, (words[row] ^ self.errors[s[row], k]) >> 11


def bucket_rows(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows of unsigned fingerprints; keys are positive longs."""
    seg = [(fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    home = [golay.home(x) for x in seg]
    keys = [golay.keys(x) for x in seg]
    out_key, out_row = [], []
    table = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, key = keys[j]
                out_key.append(table << 36 | seg[i][row] << 12 | key)
                out_row.append(row)
                table += 1
    row, key = keys[1]
    out_key.append(table << 36 | home[0][row] << 24 | key << 12 | home[2][row])
    out_row.append(row)
    # keys of segment 0 times keys of segment 2
    row0, key0 = keys[0]
    n2 = np.bincount(keys[2][0], minlength=len(fps))
    first2 = np.cumsum(n2) - n2
    times = n2[row0]
    row = np.repeat(row0, times)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    out_key.append(table << 36 | np.repeat(key0, times) << 24 | home[1][row] << 12 | keys[2][1][first2[row] + inner])
    out_row.append(row)
    return np.concatenate(out_key), fps[np.concatenate(out_row)]


def spanning_links(members: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links that span the components of a bucket: a pivot and those first reached from it."""
    rest = members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            pivot = queue.pop()
            near = np.bitwise_count(rest ^ pivot) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                yield pivot, found
                queue.extend(found)


def _links_of_sorted(max_bits: int, max_bucket: int):
    """mapInArrow step over rows sorted by key: (u, v, hot) links; hot rows name members of large buckets."""

    def emit(u, v, hot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.uint64).view(np.int64)), pa.array(np.asarray(v, np.uint64).view(np.int64)), pa.array(np.full(len(u), hot))], names=["u", "v", "hot"])

    def small(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        us, vs = [], []
        two = edge[:-1][size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        us.append(fp[two[near]])
        vs.append(fp[two[near] + 1])
        for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
            for pivot, found in spanning_links(np.unique(fp[at : at + n]), max_bits):
                us.append(np.full(len(found), pivot, np.uint64))
                vs.append(found)
        u, v = np.concatenate(us), np.concatenate(vs)
        differ = u != v
        if differ.any():
            yield emit(u[differ], v[differ], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        large = None  # key of a bucket too large to hold
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            if large is not None:
                n = int(np.searchsorted(key, large, "right"))
                if n:
                    yield emit(fp[:n], fp[:n], True)
                key, fp = key[n:], fp[n:]
                if not len(key):
                    held_key, held_fp = key, fp
                    continue
                large = None
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if last:
                yield from small(key[:last], fp[:last])
            held_key, held_fp = key[last:], fp[last:]
            if len(held_key) > max_bucket:
                large = int(held_key[0])
                yield emit(held_fp, held_fp, True)
                held_key, held_fp = held_key[:0], held_fp[:0]
        if len(held_key):
            yield from small(held_key, held_fp)

    return run


def _hub_links(hot: DataFrame) -> DataFrame:
    """Exact links among fingerprints (column u): x and y within 3 bits share a hub z with d(x, z) <= 1 and d(y, z) <= 2."""
    flips = {r: [sum(1 << p for p in places) for k in range(r + 1) for places in combinations(range(64), k)] for r in (1, 2)}

    def around(r: int):
        flip = np.array(flips[r], np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column(0).to_numpy().view(np.uint64)
                for at in range(0, len(fps), 256):
                    part = fps[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flip)).view(np.int64)), pa.array((part[:, None] ^ flip).ravel().view(np.int64))], names=["fp", "hub"])

        return hot.select("u").distinct().mapInArrow(run, "fp long, hub long")

    anchors = around(1).groupBy("hub").agg(F.min("fp").alias("anchor"))
    return around(2).join(anchors, "hub").filter(F.col("fp") != F.col("anchor")).select(F.col("fp").alias("u"), F.col("anchor").alias("v")).distinct()


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = 4096) -> DataFrame:
    """Links (u, v) that span the components of distinct fingerprints (column fp) within ``max_bits``, at most 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find up to 3 differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            all_fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), 1000):
                key, fp = bucket_rows(all_fps[at : at + 1000], golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], names=["k", "fp"])

    rows = fps.select("fp").mapInArrow(keyed, "k long, fp long")
    found = cut(rows.repartition("k").sortWithinPartitions("k").mapInArrow(_links_of_sorted(max_bits, max_bucket), "u long, v long, hot boolean").distinct())
    links = found.filter(~F.col("hot")).select("u", "v")
    hot = found.filter("hot").select("u")
    if hot.isEmpty():
        return links
    exact = _hub_links(hot) if max_bits == 3 else _hub_links(hot).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return links.union(exact)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, max_bucket: int = 4096) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest identifier that links reach, the document's own included. Null and
    empty texts, and texts without a word, have fingerprint zero and link like any other. Repeated
    rows come back as often as they came. Null identifiers name a component only where there is no
    other. An empty table gives no rows; other columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(fingerprint_links(fps, max_bits, max_bucket))
    # a component may hold many of the fingerprints, a fingerprint many of the rows: both are dealt over salts
    linked = cut(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    smallest = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = cut(salted_join(linked.select("fp", F.col("n").alias("n_rows"), "root"), smallest, "root", F.col("fp")).select("fp", F.col("n_rows").alias("n"), "component_id"))
    got = salted_join(rows, named, "fp", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return got.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
