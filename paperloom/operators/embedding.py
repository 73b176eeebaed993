"""A local embedding backend (C1): dense vectors of texts from the corpus itself, without a model file.

Terms are words, hashed to a fixed number of signed columns and weighted by log frequency and inverse
document frequency; rows have unit length. The columns are brought down to a few dimensions by a
randomised range finder (Halko, Martinsson and Tropp, 2011): the product of the rows with random
vectors is made orthonormal by a tall-skinny QR, a triangle a task, merged as a tree; the columns are
then weighed by it, and the singular vectors of what comes out are the basis. Each power iteration
repeats this with that basis in place of the random vectors. One read of the rows gives both the
triangles and the columns weighed by the product as it is; as that is linear, the matrix that makes the
product orthonormal is applied to the sums.

The driver holds matrices of columns by dimensions, whose size does not grow with the corpus. Rows stay
in Spark: texts are cut into words once, and their counts written as packed blocks, from which document
frequencies, products and the vectors of these texts are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..lineage import cut
from ..shipping import ship

WORD = re.compile(r"\w+")
#: Terms whose columns a task keeps, documents of a packed block, columns of a block of sums, parts merged in the last step.
MAX_TERMS, BLOCK_DOCS, BLOCK_COLUMNS, FAN_IN = 200_000, 256, 512, 64
#: A block is multiplied as a dense matrix if that holds at most so many numbers for each one of the block.
DENSE = 100
#: Tasks of a product for each core: what they tell does not grow with the input.
TASKS_A_CORE = 4


class Terms(dict):
    """Hashes words to columns with signs: a word's column, or its complement where the sign is minus."""

    def __init__(self, bits: int):
        super().__init__()
        self.bits, self.mask = bits, (1 << bits) - 1

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_TERMS:
            self.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        got = self[word] = h & self.mask if h >> 31 else ~(h & self.mask)
        return got

    def rows(self, texts: list[str | None]) -> Rows:
        """Columns and signed log frequencies of texts; words of a text that share a column add up."""
        words = [Counter(WORD.findall((text or "").lower())) for text in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        signed = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, lengths.sum())
        weight = 1 + np.log(np.fromiter(chain.from_iterable(n.values() for n in words), np.float64, lengths.sum()))
        at = np.repeat(np.arange(len(words)), lengths) << self.bits | np.where(signed < 0, ~signed, signed)
        cells, place = np.unique(at, return_inverse=True)
        starts = np.searchsorted(cells, np.arange(len(words) + 1) << self.bits)
        return Rows((cells & self.mask).astype(np.int32), np.bincount(place, np.where(signed < 0, -weight, weight), len(cells)), starts)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Columns and signed log frequencies of one text."""
        got = self.rows([text])
        return got.columns, got.values


@dataclass
class Rows:
    """Sparse rows: columns, each once a row, and values, and where each row starts."""

    columns: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of_texts(cls, texts: list[str | None], terms: Terms, idf: np.ndarray) -> Rows:
        return terms.rows(texts).weighted(idf)

    def weighted(self, idf: np.ndarray) -> Rows:
        """These rows with weighted columns and of unit length; rows of zeros stay."""
        values, lengths = self.values * idf[self.columns], np.diff(self.starts)
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(lengths)), lengths), values * values, len(lengths)))
        return Rows(self.columns, values / np.repeat(np.where(norms > 0, norms, 1), lengths), self.starts)

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The columns that occur and the rows as a dense matrix of these, where that is at most DENSE times as large."""
        if not len(self.columns):
            return None
        seen = np.zeros(self.columns.max() + 1, bool)
        seen[self.columns] = True
        at, n = np.flatnonzero(seen), len(self.starts) - 1
        if n * len(at) > DENSE * len(self.columns):
            return None
        out = np.zeros((n, len(at)))
        out[np.repeat(np.arange(n), np.diff(self.starts)), (np.cumsum(seen) - 1)[self.columns]] = self.values
        return at, out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Rows times a matrix of a row a column."""
        if self.dense:
            at, rows = self.dense
            return rows @ matrix[at]
        out = np.zeros((len(self.starts) - 1, matrix.shape[1]))
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.add.reduceat(self.values[:, None] * matrix[self.columns], self.starts[some], axis=0)
        return out

    def gather(self, by: np.ndarray, into: np.ndarray) -> None:
        """Adds the transposed rows times ``by``, a row a row, into a matrix of a row a column."""
        if not len(self.columns):
            return
        if self.dense:
            at, rows = self.dense
            into[at] += rows.T @ by
            return
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        at = self.columns[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        into[at[first]] += np.add.reduceat(self.values[order, None] * by[row[order]], first, axis=0)


def _triangle(block: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    return np.linalg.qr(block if before is None else np.vstack([before, block]), mode="r")


@dataclass(frozen=True)
class TextEncoder:
    """Embeds texts: weighted terms times the basis."""

    bits: int
    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def encode(self, texts: list[str | None], terms: Terms | None = None) -> np.ndarray:
        return Rows.of_texts(texts, Terms(self.bits) if terms is None else terms, self.idf).times(self.basis)

    def shortened(self) -> TextEncoder:
        """This encoder with numbers of 4 bytes, for a broadcast."""
        return TextEncoder(self.bits, self.idf.astype(np.float32), self.basis.astype(np.float32), self.values)


def backend(model: TextEncoder, rows: DataFrame) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """What ``classify.embed_texts`` takes as make_encoder; the model is broadcast, 4 bytes a column and dimension."""
    held = rows.sparkSession.sparkContext.broadcast(model.shortened())
    return lambda: partial(held.value.encode, terms=Terms(held.value.bits))


def _packed(r: Rows, others: pa.RecordBatch) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, others.schema) as out:
        out.write_batch(others)
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (r.columns.tobytes(), r.values.tobytes(), r.starts.tobytes(), sink.getvalue().to_pybytes())], names=["columns", "values", "starts", "others"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for c, v, s in zip(*(batch.column(k) for k in range(3))):
            yield Rows(np.frombuffer(c.as_py(), np.int32), np.frombuffer(v.as_py(), np.float64), np.frombuffer(s.as_py(), np.int64))


def pack_texts(docs: DataFrame, text_col: str = "text", bits: int = 14) -> DataFrame:
    """Blocks of rows of signed log frequencies, one row a text, written once; the documents' other columns stand beside them."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("_text"), *[c for c in docs.columns if c != text_col], text.isNull().alias("_null"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                yield _packed(terms.rows(part.column(0).to_pylist()), pa.RecordBatch.from_arrays(part.columns[1:], names=part.schema.names[1:]))

    return cut(texts.mapInArrow(pack, "columns binary, values binary, starts binary, others binary"))


def _merged(parts: DataFrame, width: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """What tasks tell of each block, merged in two steps: numbers are added up; the triangles, under block -1, go through a QR."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, np.float64) for x in pdf["sums"]]
        got = np.sum(held, axis=0) if pdf["block"].iloc[0] >= 0 else _triangle(np.concatenate(held).reshape(-1, width), None)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [got.tobytes()]})

    half = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("block", "g").applyInPandas(merge, "block int, sums binary")
    for r in half.groupBy("block").applyInPandas(merge, "block int, sums binary").toLocalIterator():
        yield r["block"], np.frombuffer(bytes(r["sums"]), np.float64)


def _told(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["block", "sums"])


def _frequencies(packed: DataFrame, n_columns: int) -> tuple[np.ndarray, int]:
    """Texts a column, and the number of texts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_columns + 1)
        for rows in _unpacked(batches):
            held[:-1] += np.bincount(rows.columns, minlength=n_columns)
            held[-1] += len(rows.starts) - 1
        yield _told({0: held})

    got = dict(_merged(packed.mapInArrow(local, "block int, sums binary"))).get(0, np.zeros(n_columns + 1))
    return got[:-1], int(got[-1])


def _weighed(packed: DataFrame, idf, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The triangle of rows times ``matrix``, and the transposed rows times that product: one read, merged over tasks."""
    held, (n_columns, width) = packed.sparkSession.sparkContext.broadcast(matrix), matrix.shape

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, r = np.zeros((n_columns, width)), None
        for rows in map(lambda x: x.weighted(idf.value), _unpacked(batches)):
            product = rows.times(held.value)
            r = _triangle(product, r)
            rows.gather(product, total)
        if r is not None:
            yield _told({-1: r} | {x // BLOCK_COLUMNS: total[x : x + BLOCK_COLUMNS] for x in range(0, n_columns, BLOCK_COLUMNS)})

    out, triangle = np.zeros((n_columns, width)), np.zeros((0, width))
    # a task tells sums of the matrix's size, so tasks are as many as keep the cores busy, not as many as the input has
    tasks = packed.coalesce(TASKS_A_CORE * packed.sparkSession.sparkContext.defaultParallelism)
    for block, sums in _merged(tasks.mapInArrow(local, "block int, sums binary"), width):
        if block < 0:
            triangle = sums.reshape(-1, width)
        else:
            out[block * BLOCK_COLUMNS : (block + 1) * BLOCK_COLUMNS] = sums.reshape(-1, width)
    return triangle, out


def _whitening(triangle: np.ndarray) -> np.ndarray:
    """The matrix that makes the columns of a product with this triangle orthonormal."""
    if not len(triangle):
        return np.zeros((triangle.shape[1], 0))
    _, s, vt = np.linalg.svd(triangle)
    rank = int((s > s[0] * 1e-10).sum()) if s[0] > 0 else 0
    return vt[:rank].T / s[:rank]


def fit_text_encoder(docs: DataFrame, text_col: str = "text", dimensions: int = 64, bits: int = 14, more: int = 10, iterations: int = 1, seed: int = 7) -> TextEncoder:
    """An encoder of ``dimensions`` fitted on all texts.

    2^bits columns; ``more`` random vectors than dimensions; ``iterations`` power iterations sharpen the
    basis, one read of the packed rows each. Null and empty texts are rows without terms. With fewer
    independent texts than dimensions the others are zero. The driver holds some matrices of 8 x 2^bits
    x (dimensions + more) bytes.
    """
    return fit_packed(pack_texts(docs.select(text_col), text_col, bits), dimensions, bits, more, iterations, seed)


def fit_and_embed(docs: DataFrame, text_col: str = "text", name: str = "embedding", dimensions: int = 64, bits: int = 14, **fit) -> tuple[TextEncoder, DataFrame]:
    """fit_text_encoder's encoder, and ``docs`` with the vectors of its own texts in place of these, which are cut into words but once.

    The vectors are those of ``classify.embed_texts`` with ``backend``; null texts have a null vector.
    """
    packed = pack_texts(docs, text_col, bits)
    model = fit_packed(packed, dimensions, bits, **fit)
    held = docs.sparkSession.sparkContext.broadcast(model.shortened())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in enumerate(_unpacked([batch])):
                others = pa.ipc.open_stream(batch.column(3)[k].as_py()).read_next_batch()
                found = rows.weighted(held.value.idf).times(held.value.basis).astype(np.float32)
                at = pa.array(np.arange(0, found.size + 1, dimensions), pa.int32())
                got = pa.ListArray.from_arrays(at, pa.array(found.ravel()), mask=others.column(others.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*others.columns[:-1], got], names=[*others.schema.names[:-1], name])

    schema = docs.drop(text_col).schema.add(name, ArrayType(FloatType()))
    return model, packed.mapInArrow(vectors, schema)


def fit_packed(packed: DataFrame, dimensions: int = 64, bits: int = 14, more: int = 10, iterations: int = 1, seed: int = 7) -> TextEncoder:
    """The encoder of packed texts; see fit_text_encoder."""
    n_columns = 1 << bits
    df, n_docs = _frequencies(packed, n_columns)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    shared = packed.sparkSession.sparkContext.broadcast(idf)
    basis = np.random.default_rng(seed).standard_normal((n_columns, dimensions + more))
    values = np.zeros(0)
    for _ in range(iterations + 1):
        triangle, sums = _weighed(packed, shared, basis)
        orthonormal = _whitening(triangle)
        if not orthonormal.shape[1]:
            basis = np.zeros((n_columns, 0))
            break
        basis, values, _ = np.linalg.svd(sums @ orthonormal, full_matrices=False)
    basis, values = basis[:, :dimensions], values[:dimensions]
    sign = np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])]) if basis.shape[1] else np.zeros(0)
    lacking = dimensions - basis.shape[1]
    return TextEncoder(bits, idf, np.pad(basis * sign, ((0, 0), (0, lacking))), np.pad(values, (0, lacking)))
