"""SentencePiece encoding and decoding (operator 2), with a max-plus parallel scan for giant texts.

A text of ordinary length is encoded by the library. A giant one is split into chunks at arbitrary
places. The library's merges are reproduced exactly by a lattice in which two neighbouring tokens
are joined by an edge only if encoding their concatenation gives just these two: a path of such
edges is the encoding of the whole, and the only one. A chunk's boundary state is the token that
ends at or reaches over the boundary. Each chunk yields a max-plus matrix from states at its left
boundary to states at its right one (absent where no path leads); matrices combine associatively,
runs of chunks in parallel and then the runs of a text; and with its two states known, each chunk
is traced back by itself. Weights count tokens, negatively.

Where a space follows another character no piece reaches over, so paths meet there: from the first
such place of a chunk to the last the library fills in, and the lattice is walked at the edges only.
A chunk without such a place is walked throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import cut, ship, steps

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT_CHARS = 32_768
CHUNK_CHARS = 8_192
RUN_CHUNKS = 256
#: Pairs of tokens whose verdict a worker keeps.
MAX_PAIRS = 100_000
START = (0, 0)


class Pieces:
    """A BPE model of the library: its pieces, and walks over its lattice."""

    def __init__(self, proto: bytes):
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if lib.decode(lib.encode(" a  b ")) != " a  b " or MARK + "a" not in (lib.id_to_piece(i) for i in lib.encode("a")):
            raise ValueError("a model that keeps white space and marks the first word is needed")
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size()) if not special(i)}
        self.number = {p: lib.piece_to_id(p) for p in self.score}
        self.longest = max(map(len, self.score))
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece reaches over a word's start")
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Encoding of a short marked text: the best-scored neighbours merge first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joins(self, a: str, b: str) -> bool:
        """Whether tokens a and b may stand side by side; a is empty at the text's start."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return got

    def is_token(self, text: str) -> bool:
        return len(text) == 1 or text in self.score and self.joins("", text)

    def ids(self, token: str) -> list[int]:
        n = self.number.get(token)
        if n is not None:
            return [n]
        raw = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in token.encode("utf-8", "surrogatepass")]
        return raw if all(map(self.lib.is_byte, raw)) else [self.lib.unk_id()]

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Tokens that end at or reach over a place, as (start, end) relative to it."""
        return [(s - at, e - at) for s in range(max(0, at - self.longest), at) for e in range(at, min(len(text), s + self.longest) + 1) if self.is_token(text[s:e])]

    def walk(self, text: str, start: int, end: int, to: int, over: int) -> dict[int, int]:
        """Paths on from the token start..end: place -> start of the one token that ends there.

        Tokens begin before ``to`` and end at ``over`` at the latest.
        """
        last = {end: start}
        for e in range(end + 1, min(over, len(text)) + 1):
            for s in range(max(end, e - self.longest), min(e, to)):
                if s in last and self.is_token(text[s:e]) and self.joins(text[last[s] : s], text[s:e]):
                    last[e] = s
                    break
        return last

    def fill(self, text: str) -> list[int]:
        """Ids of a marked text that starts at a word's start and ends before one."""
        return self.lib.encode(text[1:].replace(MARK, " ")) if text else []

    def breaks(self, text: str, low: int, high: int) -> list[int]:
        """First and last word's start in low..high, by a search from either side."""
        found = []
        for places in (range(max(low, 1), high + 1), range(high, max(low, 1) - 1, -1)):
            for i in places:
                if i < len(text) and text[i] == MARK and text[i - 1] != MARK:
                    found.append(i)
                    break
        return found


def trace(last: dict[int, int], end: int, stop: int) -> list[tuple[int, int]]:
    """Tokens from ``stop`` to ``end``."""
    out = []
    while end > stop:
        out.append((last[end], end))
        end = last[end]
    return out[::-1]


class Chunk:
    """A chunk text[left:right] within its context. ``first`` and ``final`` tell a text's ends."""

    def __init__(self, pieces: Pieces, text: str, left: int, right: int, first: bool, final: bool):
        self.pieces, self.text, self.left, self.right, self.first, self.final = pieces, text, left, right, first, final

    def entries(self) -> list[tuple[int, int]]:
        return [START] if self.first else self.pieces.states(self.text, self.left)

    def _exits(self, last: dict[int, int]) -> list[tuple[int, int]]:
        ends = [self.right] if self.final else range(self.right, self.right + self.pieces.longest + 1)
        return [(last[e] - self.right, e - self.right) for e in ends if e in last and last[e] < self.right]

    def _open(self, state: tuple[int, int]):
        """Walk from an entry: (walk, None) to the chunk's end, or (walk, first word's start)."""
        s, e = state[0] + self.left, state[1] + self.left
        found = self.pieces.breaks(self.text, e, self.right - 1)
        if not found:
            return self.pieces.walk(self.text, s, e, self.right, self.right + (0 if self.final else self.pieces.longest)), None
        return self.pieces.walk(self.text, s, e, found[0], found[0]), found

    def matrix(self) -> list[int]:
        """Cells (entry start, entry end, exit start, exit end, weight), flattened."""
        cells: list[int] = []
        filled: dict[int, int] = {}
        tails: dict[int, tuple[dict[int, int], list]] = {}
        for state in self.entries():
            e = state[1] + self.left
            last, found = self._open(state)
            if found is None:
                cells += [x for out in self._exits(last) for x in (*state, *out, -len(trace(last, out[1] + self.right, e)))]
                continue
            low, high = found
            if low not in last:
                continue
            if low not in filled:
                filled[low] = len(self.pieces.fill(self.text[low:high]))
            if high not in tails:
                tail = self.pieces.walk(self.text, high, high, self.right, self.right + (0 if self.final else self.pieces.longest))
                tails[high] = tail, self._exits(tail)
            tail, outs = tails[high]
            head = len(trace(last, low, e)) + filled[low]
            cells += [x for out in outs for x in (*state, *out, -head - len(trace(tail, out[1] + self.right, high)))]
        return cells

    def ids(self, entry: tuple[int, int], out: tuple[int, int]) -> tuple[list[int], str]:
        """Ids of the tokens after the entry's, up to the exit's, and the marked text that they cover."""
        e, end = entry[1] + self.left, out[1] + self.right
        last, found = self._open(entry)
        spell = lambda tokens: [n for s, t in tokens for n in self.pieces.ids(self.text[s:t])]
        if found is None:
            return spell(trace(last, end, e)), self.text[e:end]
        low, high = found
        tail = self.pieces.walk(self.text, high, high, self.right, self.right + (0 if self.final else self.pieces.longest))
        return spell(trace(last, low, e)) + self.pieces.fill(self.text[low:high]) + spell(trace(tail, end, high)), self.text[e:end]


def cells_of(flat) -> dict[tuple, dict[tuple, int]]:
    out: dict[tuple, dict[tuple, int]] = {}
    for a, b, c, d, w in np.asarray(flat, dtype=np.int64).reshape(-1, 5).tolist():
        out.setdefault((a, b), {})[c, d] = w
    return out


def combine(a: dict, b: dict) -> dict:
    """Max-plus product of two matrices."""
    out: dict = {}
    for i, row in a.items():
        got: dict = {}
        for k, w in row.items():
            for j, v in b.get(k, {}).items():
                if j not in got or w + v > got[j]:
                    got[j] = w + v
        if got:
            out[i] = got
    return out


def best_states(matrices: list[dict], entry: tuple | None, out: tuple | None) -> list[tuple[tuple, tuple]]:
    """(entry, exit) of each matrix on the best path, between given ends where these are known."""
    alive = {i: 0 for i in matrices[0]} if entry is None else {entry: 0}
    back: list[dict] = []
    for m in matrices:
        reached: dict = {}
        for i, w in alive.items():
            for j, v in m.get(i, {}).items():
                if j not in reached or w + v > reached[j][0]:
                    reached[j] = (w + v, i)
        back.append({j: i for j, (_, i) in reached.items()})
        alive = {j: w for j, (w, _) in reached.items()}
    at = out if out is not None else max(sorted(alive), key=alive.get)
    path = []
    for b in reversed(back):
        path.append((b[at], at))
        at = b[at]
    return path[::-1]


def split_marked(text: str, chunk_chars: int, context: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """(number, text with context, left, right, first, final) of each chunk of a marked text."""
    bounds = list(range(0, len(text), chunk_chars))
    if len(bounds) > 1 and len(text) - bounds[-1] < context:
        bounds.pop()
    for k, a in enumerate(bounds):
        final = k + 1 == len(bounds)
        b = len(text) if final else bounds[k + 1]
        low = max(0, a - context)
        yield k, text[low : min(len(text), b + context)], a - low, b - low, k == 0, final


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: id, n_tokens, ids, n_chars, round_trip.

    ``ids`` are those that the library gives for the whole text. They are decoded again: n_chars
    counts the decoded text and round_trip tells whether it equals the input, which fails only for
    texts that hold the library's own space mark (U+2581), since that decodes to a space. Null and
    empty texts have no tokens and return as an empty text. Rows may repeat; an empty table gives
    no rows; other columns are ignored. The model file is read on the driver and broadcast; it is
    no part of the data.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    longest = Pieces(proto.value).longest
    if chunk_chars < 4 * longest or giant_chars < chunk_chars:
        raise ValueError("chunks are too short for this model")
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    result = f"id {kind.simpleString()}, n_tokens long, ids array<int>, n_chars long, round_trip boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        for batch in batches:
            at = 0
            for part in steps(batch.column(1)):
                texts = part.to_pylist()
                got = lib.encode(texts)
                back = lib.decode(got)
                counts = np.fromiter(map(len, got), np.int64, len(got))
                flat = pa.array(np.concatenate([np.array(x, np.int32) for x in got]) if got else [], pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts), ids, pa.array([len(x) for x in back], pa.int64()), pa.array([x == y for x, y in zip(back, texts)])], names=["id", "n_tokens", "ids", "n_chars", "round_trip"])
                at += len(texts)

    small = rows.filter(F.length("text") <= giant_chars).mapInArrow(whole, result)

    chunk_names = ["key", "id", "plain", "chunk", "text", "left", "right", "first", "final"]
    chunk_types = [pa.int64(), id_type, pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one giant text at a time becomes a Python string
                key, id_, text = (batch.column(k)[row].as_py() for k in range(3))
                held: list[tuple] = []
                for part in split_marked(marked(text), chunk_chars, longest):
                    held.append((key, id_, MARK not in text, *part))
                    if len(held) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), chunk_types)], names=chunk_names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), chunk_types)], names=chunk_names)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(proto.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                cells = [Chunk(pieces, r["text"], r["left"], r["right"], r["first"], r["final"]).matrix() for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*chunk_names, "cells"])

    giant = rows.filter(F.length("text") > giant_chars).withColumn("key", F.monotonically_increasing_id()).select("key", "id", "text")
    shape = f"key long, id {kind.simpleString()}, plain boolean, chunk int, text string, left int, right int, first boolean, final boolean"
    chunks = cut(giant.mapInArrow(split, shape).repartition("key", "chunk").mapInArrow(measure, f"{shape}, cells array<long>"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total = cells_of(pdf["cells"].iloc[0])
        for flat in pdf["cells"].iloc[1:]:
            total = combine(total, cells_of(flat))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "run": [pdf["run"].iloc[0]], "cells": [[x for i, row in total.items() for j, w in row.items() for x in (*i, *j, w)]]})

    def picks(pdf: pd.DataFrame, place: str, **ends) -> pd.DataFrame:
        pdf = pdf.sort_values(place)
        path = best_states([cells_of(x) for x in pdf["cells"]], ends.get("entry"), ends.get("out"))
        return pd.DataFrame({"key": pdf["key"], place: pdf[place], "states": [[*i, *j] for i, j in path]})

    def of_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        return picks(pdf, "run", entry=START)

    def of_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c, d = (int(x) for x in pdf["states"].iloc[0])
        return picks(pdf, "chunk", entry=(a, b), out=(c, d))

    matrices = chunks.select("key", "chunk", F.floor(F.col("chunk") / RUN_CHUNKS).cast("int").alias("run"), "cells")
    runs = matrices.groupBy("key", "run").applyInPandas(product, "key long, run int, cells array<long>")
    ends = runs.groupBy("key").applyInPandas(of_runs, "key long, run int, states array<long>")
    states = matrices.join(ends, ["key", "run"]).groupBy("key", "run").applyInPandas(of_chunks, "key long, chunk int, states array<long>")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(proto.value)
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            out = []
            for r in batch.to_pylist():
                a, b, c, d = r["states"]
                ids, covered = Chunk(pieces, r["text"], r["left"], r["right"], r["first"], r["final"]).ids((a, b), (c, d))
                back, text = decode_ids(pieces.lib, ids, not r["first"]), covered.replace(MARK, " ")[1 if r["first"] else 0 :]
                out.append((r["key"], r["id"], r["chunk"], ids, len(back), r["plain"] and back == text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), id_type, pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.bool_()])], names=["key", "id", "chunk", "ids", "n_chars", "same"])

    spelt = chunks.drop("cells").join(states, ["key", "chunk"]).select(*chunk_names, "states").mapInArrow(spell, f"key long, id {kind.simpleString()}, chunk int, ids array<int>, n_chars long, same boolean")
    joined = spelt.groupBy("key").agg(F.first("id").alias("id"), F.flatten(F.sort_array(F.collect_list(F.struct("chunk", "ids")))["ids"]).alias("ids"), F.sum("n_chars").alias("n_chars"), F.every("same").alias("round_trip"))
    large = joined.select("id", F.size("ids").cast("long").alias("n_tokens"), "ids", "n_chars", "round_trip")
    return small.union(large).withColumnRenamed("id", id_col)


def decode_ids(lib: sentencepiece.SentencePieceProcessor, ids: list[int], inner: bool = False) -> str:
    """Text of ids; ``inner`` tells that they do not start a text, so a leading space stays."""
    if not inner or not ids:
        return lib.decode(ids)
    plain = lib.encode("a")
    return lib.decode(plain + ids)[1:]


def decode_documents(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """(id, text) of encoded documents; null ids give an empty text."""
    spark = rows.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [lib.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
