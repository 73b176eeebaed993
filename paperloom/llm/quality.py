"""Quality rules (operator 8): word and line counts, and zstandard compression bands.

Compressed size over raw size is taken of the whole document and of fixed chunks. Ratios fall with
the length, as the compressor has more to refer to, so each length class (a quarter of an octave)
has limits of its own. They are calibrated on the corpus: a histogram of all documents that pass
the base rules gives the quartiles of each class, and the band reaches some interquartile ranges
beyond them. Prose is dense around its class's median; repetitive and symbol-salted text and tables
fall below the band, encoded and random text lies above it. Absolute limits hold beside, so that a
corpus of junk does not pass for the norm.

A document is rejected when its whole ratio, or that of a large part of its chunks, is out of band.
""" 

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, text_column_udf

#: Ratios out of these are rejected whatever the corpus holds.
LEAST, GREATEST = 0.12, 0.90
#: Bytes under which no ratio is judged, since a frame's header and the literals dominate it.
LEAST_BYTES = 256
CHUNK_BYTES = 4096
#: Interquartile ranges that the band reaches beyond the quartiles. Above it is wider, as names, numbers and keys lengthen that tail.
BELOW, ABOVE = 3.0, 4.0
#: Share of chunks out of their band from which a document is rejected.
BAD_CHUNKS = 0.5
#: Ratios that a class's quartiles rest on at least; classes with fewer take in their neighbours'.
LEAST_RATIOS = 100
CLASSES_AN_OCTAVE = 4
#: Bins of the histogram between ratio 0 and 1; greater ratios share the last.
BINS = 1_000
LEVEL = 3
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first such window included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # wider numbers: name the pairs first
        _, pairs = np.unique(np.stack([ids[:-1], ids[1:]], 1), axis=0, return_inverse=True)
        windows = pairs.reshape(-1)[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


class Measure:
    """Counts and compression ratios of texts; holds one compressor."""

    def __init__(self, chunk_bytes: int = CHUNK_BYTES):
        self.chunk_bytes = chunk_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def ratio(self, raw: bytes | memoryview) -> float:
        return len(self.compressor.compress(raw)) / len(raw)

    def row(self, text: str | None) -> dict:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes.split() cuts at ASCII white space only
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeats = repeated_words(words)
        view = memoryview(raw)
        chunks = [view[at : at + self.chunk_bytes] for at in range(0, len(raw), self.chunk_bytes)] if len(raw) > self.chunk_bytes else []
        return {
            "n_words": len(words), "word_chars": len(text or "") - (len(raw) - sum(map(len, words))), "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats, "base_failed": len(words) < 50 or 100 * repeats > 50 * len(words),
            "n_bytes": len(raw), "zstd_ratio": self.ratio(raw) if len(raw) >= LEAST_BYTES else None,
            "chunks": [{"bytes": len(c), "ratio": self.ratio(c)} for c in chunks if len(c) >= LEAST_BYTES],
        }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, zstd_ratio double, chunks array<struct<bytes:long,ratio:double>>"


def quality_measures(text: Column, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """Struct of the counts and ratios of a text column; see SCHEMA. A text of one chunk has no chunks beside the whole."""

    def make():
        measure = Measure(chunk_bytes)

        def run(texts: list[str | None]) -> dict[str, list]:
            rows = [measure.row(t) for t in texts]
            return {k: [r[k] for r in rows] for k in (rows[0] if rows else ())}

        return run

    return text_column_udf(SCHEMA, make)(text)


def length_class(n_bytes: Column) -> Column:
    return F.floor(F.log2(n_bytes.cast("double")) * CLASSES_AN_OCTAVE).cast("int")


@dataclass
class Bands:
    """Least and greatest ratio by length class, from class ``first`` on; one list for whole documents, one for chunks."""

    first: int
    whole: list[tuple[float, float]]
    chunk: list[tuple[float, float]]

    def outside(self, n_bytes: Column, ratio: Column, of: str) -> Column:
        """Whether a ratio is out of its class's band; longer lengths than any seen take the last class's."""
        bands = getattr(self, of)
        out = (ratio < LEAST) | (ratio > GREATEST)
        if not bands:
            return out
        at = F.greatest(F.lit(1), F.least(F.lit(len(bands)), length_class(n_bytes) - self.first + 1))
        low, high = (F.element_at(F.array(*[F.lit(b[k]) for b in bands]), at) for k in (0, 1))
        return out | (ratio < low) | (ratio > high)


def quartiles(counts: np.ndarray) -> tuple[float, float]:
    """First and third quartile of a histogram over BINS + 1 bins, linear within a bin."""
    total = np.concatenate([[0], np.cumsum(counts)])
    found = []
    for share in (0.25, 0.75):
        want = share * total[-1]
        at = int(np.searchsorted(total, want, "left"))
        at = max(1, at)
        found.append((at - 1 + (want - total[at - 1]) / max(1, counts[at - 1])) / BINS)
    return found[0], found[1]


def trend(histogram: np.ndarray) -> np.ndarray:
    """Bin at which each class's middle is expected: a parabola over the classes' mean bins, weighted by their counts."""
    n = histogram.sum(axis=1)
    classes = np.arange(len(histogram))
    some = n > 0
    means = (histogram[some] @ np.arange(histogram.shape[1])) / n[some]
    return np.polyval(np.polyfit(classes[some], means, min(2, int(some.sum()) - 1), w=np.sqrt(n[some])), classes)


def class_bands(histogram: np.ndarray, below: float = BELOW, above: float = ABOVE, least: int = LEAST_RATIOS) -> list[tuple[float, float]]:
    """Band of each class (row of ``histogram``).

    A class of fewer than ``least`` ratios takes in its neighbours', moved by what the trend says
    that the two classes differ.
    """
    if histogram.sum() < least:
        return [(LEAST, GREATEST)] * len(histogram)
    expected = trend(histogram)
    out = []
    for c in range(len(histogram)):
        for reach in range(len(histogram)):
            near = range(max(0, c - reach), min(len(histogram), c + reach + 1))
            if histogram[near].sum() >= least:
                break
        mine = np.zeros(BINS + 1, np.int64)
        for d in near:
            bins = np.flatnonzero(histogram[d])
            np.add.at(mine, np.clip(bins + round(expected[c] - expected[d]), 0, BINS), histogram[d, bins])
        low, high = quartiles(mine)
        out.append((low - below * (high - low), high + above * (high - low)))
    return out


def calibrate(measured: DataFrame, below: float = BELOW, above: float = ABOVE, least: int = LEAST_RATIOS) -> Bands:
    """Bands from all documents that pass the base rules. Counts by class and bin reach the driver: at most 2 x 128 x 1,001 rows."""
    passing = measured.filter("not base_failed and zstd_ratio is not null")
    cell = lambda of, n, ratio: F.struct(F.lit(of).alias("of"), length_class(n).alias("class"), F.least(F.lit(BINS), F.floor(ratio * BINS)).cast("int").alias("bin"))
    whole = F.array(cell("whole", F.col("n_bytes"), F.col("zstd_ratio")))
    chunks = F.transform("chunks", lambda c: cell("chunk", c["bytes"], c["ratio"]))
    counts = passing.select(F.explode(F.concat(whole, chunks)).alias("c")).groupBy("c.of", "c.class", "c.bin").count().collect()
    if not counts:
        return Bands(0, [], [])
    first, last = min(r["class"] for r in counts), max(r["class"] for r in counts)
    bands = {}
    for of in ("whole", "chunk"):
        histogram = np.zeros((last - first + 1, BINS + 1), np.int64)
        for r in counts:
            if r["of"] == of:
                histogram[r["class"] - first, r["bin"]] += r["count"]
        bands[of] = class_bands(histogram, below, above, least)
    return Bands(first, bands["whole"], bands["chunk"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, below: float = BELOW, above: float = ABOVE, bad_chunks: float = BAD_CHUNKS, least: int = LEAST_RATIOS) -> DataFrame:
    """One row per document: id, counts, base_failed, kept, zstd_ratio, bad_chunk_share.

    Null text counts as empty: no words, so base_failed. zstd_ratio is null below LEAST_BYTES and
    bad_chunk_share for texts of one chunk. Whole texts are compressed once; their counts and ratios
    are kept in the shared folder while the bands are calibrated on all of them. Only counts of
    ratios are shuffled, so hot groups, repeated rows and ties do not matter; an empty table gives
    no rows; other columns are ignored. In a table with fewer than ``least`` documents that pass the
    base rules only the absolute limits judge.
    """
    measured = cut(docs.select(F.col(id_col).alias("id"), quality_measures(F.col(text_col), chunk_bytes).alias("q")).select("id", "q.*"))
    bands = calibrate(measured, below, above, least)
    bad = F.coalesce(bands.outside(F.col("n_bytes"), F.col("zstd_ratio"), "whole"), F.lit(False))
    n_bad = F.size(F.filter("chunks", lambda c: bands.outside(c["bytes"], c["ratio"], "chunk")))
    share = F.when(F.size("chunks") > 0, n_bad / F.size("chunks"))
    judged = measured.withColumn("bad_chunk_share", share)
    kept = ~F.col("base_failed") & ~bad & (F.coalesce("bad_chunk_share", F.lit(0.0)) < bad_chunks)
    return judged.select(F.col("id").alias(id_col), *BASE, kept.alias("kept"), "zstd_ratio", "bad_chunk_share")
