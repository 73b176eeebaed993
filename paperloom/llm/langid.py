"""Language identification (operator 9): multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages) is broadcast; texts are scored in batches in
numpy. A batch is a sparse matrix whose row pointers are the document offsets and whose column
indices are the n-gram buckets, every entry one; its product with the matrix is a gather and a
segmented sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import STEP_CHARS, ship, text_column_udf

UNKNOWN = "und"
#: Characters times languages that a step of scoring holds as an array of floats.
STEP_CELLS = 4_000_000
ORDERS = (1, 2, 3)
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for everything that is no letter."""
    if not _FOLD:
        fold = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(fold)
    return _FOLD[0]


def code_points(text: str) -> np.ndarray:
    return fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of each n-gram; entry i starts at character i."""
    h = points[: len(points) - order + 1].astype(np.uint64)
    for k in range(1, order):
        h = h * np.uint64(0x200003) + points[k : len(points) - order + 1 + k]
    h = (h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # float32, buckets x languages
    log_prior: np.ndarray
    bits: int

    @property
    def step_chars(self) -> int:
        """Characters whose gathered rows make up STEP_CELLS cells."""
        return max(1, STEP_CELLS // max(1, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text; und and 0.0 where there is no letter."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        group: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, t in enumerate(texts):
            points = code_points(t or "")
            if not (points != 32).any():
                continue
            if len(points) > self.step_chars:
                self._tell([i], self._sum_long(points)[None], names, scores)
                continue
            if held + len(points) > self.step_chars:
                self._tell([k for k, _ in group], self._sum_short([a for _, a in group]), names, scores)
                group, held = [], 0
            group.append((i, points))
            held += len(points)
        if group:
            self._tell([k for k, _ in group], self._sum_short([a for _, a in group]), names, scores)
        return names, scores

    def _tell(self, at: list[int], totals: np.ndarray, names: list[str], scores: list[float]) -> None:
        totals = totals + self.log_prior
        post = np.exp(totals - totals.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        best = totals.argmax(axis=1)
        for row, i in enumerate(at):
            names[i], scores[i] = self.languages[best[row]], float(post[row, best[row]])

    def _sum_short(self, arrays: list[np.ndarray]) -> np.ndarray:
        """Log-likelihoods of several texts: one gather and a segmented sum an order; n-grams are cut at each text's end."""
        lengths = np.array([len(a) for a in arrays])
        joined = np.concatenate([*arrays, np.full(max(ORDERS), 32, np.uint32)])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        totals = np.zeros((len(arrays), len(self.languages)))
        for order in ORDERS:
            ends = starts + np.maximum(lengths - order + 1, 0)
            rows = self.log_prob[buckets(joined, order, self.bits)]
            sums = np.add.reduceat(rows, np.stack([starts, ends], 1).ravel(), axis=0, dtype=np.float64)[::2]
            totals += np.where((ends > starts)[:, None], sums, 0.0)
        return totals

    def _sum_long(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.languages))
        for at in range(0, len(a), self.step_chars):
            for order in ORDERS:
                out += self.log_prob[buckets(a[at : at + self.step_chars + order - 1], order, self.bits)].sum(axis=0, dtype=np.float64)
        return out


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows_per_language: int = 5_000, max_languages: int = 1_000, bits: int = 15, smoothing: float = 0.5) -> LanguageModel:
    """Fit on at most about ``max_rows_per_language`` rows a language, drawn by a hash of the identifier.

    Rows with null text or language are ignored; priors come from all rows, so repeated rows count as
    often as they stand. An empty table gives a model that knows no language. Other columns are
    ignored. The matrix that is broadcast has a column of 4 x 2^bits bytes for each language; more
    than ``max_languages`` raise a ValueError before anything of their size is made, and a caller with
    more memory may raise the number.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits)
    share = spark.createDataFrame([(x, min(1.0, max_rows_per_language / sizes[x])) for x in languages], "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").filter(F.pmod("draw", F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, text in zip(langs, texts):
                if lang not in held:
                    held[lang] = np.zeros(1 << bits, np.int32)
                mine = held[lang]
                points = code_points(text)
                for at in range(0, len(points), STEP_CHARS):
                    for order in ORDERS:
                        mine += np.bincount(buckets(points[at : at + STEP_CHARS + order - 1], order, bits), minlength=1 << bits)
        for lang, mine in held.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(mine[at], pa.int64())], names=["lang", "bucket", "n"])

    summed = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        """One language's log-probabilities, as float32 bytes."""
        counts = np.full(1 << bits, smoothing)
        counts[pdf["bucket"]] += pdf["n"]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "log_prob": [np.log(counts / counts.sum()).astype("<f4").tobytes()]})

    # a row of 4 x 2^bits bytes a language reaches the driver; a language without a counted n-gram is even over the buckets
    log_prob = np.full((1 << bits, len(languages)), -math.log(1 << bits), np.float32)
    at = {x: i for i, x in enumerate(languages)}
    for r in summed.groupBy("lang").applyInPandas(column, "lang string, log_prob binary").toLocalIterator():
        log_prob[:, at[r["lang"]]] = np.frombuffer(bytes(r["log_prob"]), "<f4")
    total = sum(sizes.values())
    return LanguageModel(languages, log_prob, np.array([math.log(sizes[x] / total) for x in languages]), bits)


def predict_language(model: LanguageModel, docs: DataFrame, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) of a text column. No shuffle: the model is broadcast.

    Null text, empty text and text without a letter give ('und', 0.0), and so does every text if
    the model knows no language. Ties go to the language first in code-point order. Texts of any
    length are scored whole; a step holds a bounded number of characters times languages. Repeated
    rows get equal values; an empty table gives no rows; only the text column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts: list[str | None]) -> dict[str, list]:
            names, scores = shared.value.predict(texts)
            return {"lang_pred": names, "score": scores}

        return run

    return text_column_udf("lang_pred string, score double", make)(F.col(text_col))

