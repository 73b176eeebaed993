"""BPE encoding and decoding over a trie of words that share prefixes (operator 13).

A text is normalised and cut into words; merges never reach over a word. The distinct words of a
task are inserted into a trie, depth first: in their order each word adds only the nodes below the
prefix it shares with the words before. A node's state is the last token of its prefix's encoding.
Two tokens may stand side by side if merging their concatenation gives just these two, and of the
tokens that end at a place exactly one follows the encoding before it; so a node's state follows from
those of its ancestors, and a shared prefix is encoded once. The encoding of a word is read from its
end back, from state to state.

A word's last character carries the end-of-word mark and is a symbol of its own: it is the step from
a node to a word's end, and not a node.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import ship, text_column_udf

MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: Nodes and words that a task keeps; beyond, it starts a new trie.
MAX_NODES = 400_000
MAX_WORDS = 300_000
#: A longer word passes through a trie of its own.
LONG_WORD = 128
#: Verdicts on pairs of tokens that a task keeps.
MAX_PAIRS = 1_000_000
#: Characters of a long text that are cut into words at a time.
STEP_CHARS = 1_000_000
#: Outside of these characters lower-casing, composition or classes of Python and of the library may differ.
AGREED = regex.compile(r"[\x09-\x0D\x20-\x7E\xA1-\u024F]*")
#: Fixed by the model file: how words are cut.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merges:
    """Tokens of a BPE model, and which of them may stand side by side."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"]
        self.id = model["vocab"]
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or not self.end:
            raise ValueError("a plain BPE model with end-of-word marks is needed")
        self.text = {i: t for t, i in self.id.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole = self.id[a + b]
            pair = self.id[a], self.id[b]
            if whole in self.made or any(x in self.parts and self.made[x] > rank for x in pair):
                raise ValueError("a token is made by two merges, or before its parts")
            self.rank[pair], self.parts[whole], self.made[whole] = rank, pair, rank
        self.pairs: dict[int, bool] = {}  # by both tokens, packed
        last = len(self.rank)
        #: For each token, the tokens at its left or right edge while it is merged, with the rank at which each is taken up.
        self.left_edge = {t: self._edge(t, 0, last) for t in self.text}
        self.right_edge = {t: self._edge(t, 1, last) for t in self.text}
        #: A token that its own text does not give never occurs.
        found: dict[int, bool] = {}
        for t in sorted(self.text, key=lambda t: self.made.get(t, -1)):
            found[t] = t not in self.parts or all(found[x] for x in self.parts[t]) and not self._crossed(*self.parts[t], self.made[t])
        #: Ends of tokens: the token if it is a whole one, or -1. A text that is no end of a token has no longer one.
        self.ending: dict[str, int] = {}
        for text, i in self.id.items():
            if found[i]:
                body = text.removesuffix(self.end)
                mark = self.end if len(body) < len(text) else ""
                for at in range(1, len(body)):
                    self.ending.setdefault(body[at:] + mark, -1)
                self.ending[text] = i

    def _edge(self, token: int, side: int, last: int) -> list[tuple[int, int]]:
        out, taken = [(token, last)], last
        while token in self.parts:
            taken, token = self.made[token], self.parts[token][side]
            out.append((token, taken))
        return out

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank under ``before`` reaches over the boundary of a and b while each is merged.

        Ranks grow from parts to wholes, so a piece stands until the rank that takes it up. Of equal
        ranks the leftmost goes first: that inside a before the boundary's, and that before the one inside b.
        """
        for x, x_taken in self.right_edge[a]:
            for y, y_taken in self.left_edge[b]:
                r = self.rank.get((x, y))
                if r is not None and r < before and r < x_taken and r <= y_taken:
                    return True
        return False

    def joins(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = not self._crossed(a, b, len(self.rank))
        return got


class WordTrie:
    """Prefixes of words with the last token of each."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[int, int] = {}  # by node and character, packed
        self.last = [-1]  # of each node the last token; the root has none
        self.start = [-1]  # and the node before that token

    def state(self, word: str, to: int, path: list[int], mark: str) -> tuple[int, int]:
        """The token that ends the encoding of word[:to] and the node it follows; ``path`` holds the nodes of shorter prefixes."""
        ending, joins, last = self.merges.ending, self.merges.joins, self.last
        for at in range(to - 1, -1, -1):
            t = ending.get(word[at:to] + mark)
            if t is None:
                break
            if t >= 0 and (at == 0 or joins(last[path[at]], t)):
                return t, path[at]
        raise ValueError(f"the model lacks a symbol of {word!r}")

    def encode(self, word: str) -> list[int]:
        """Ids of a word that is not empty; nodes that its prefixes lack are added below those they have."""
        path = [0]
        for to in range(1, len(word)):
            edge = path[-1] << 21 | ord(word[to - 1])
            node = self.child.get(edge)
            if node is None:
                token, before = self.state(word, to, path, "")
                node = self.child[edge] = len(self.last)
                self.last.append(token)
                self.start.append(before)
            path.append(node)
        token, node = self.state(word, len(word), path, self.merges.end)
        out = [token]
        while node:
            out.append(self.last[node])
            node = self.start[node]
        return out[::-1]


def byte_characters() -> dict[int, str]:
    """Fixed by the model's format: bytes that print as themselves stay, the others are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


def word_steps(text: str, size: int) -> Iterator[str]:
    """Parts of a text that begin with a space, but for the first: neither words, marks nor composition reach over these."""
    at = 0
    while at < len(text):
        stop = text.find(" ", at + size)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop]
        at = stop


class Encoder:
    """Encodes and decodes whole texts by a model file of the library."""

    def __init__(self, source: str):
        model = json.loads(source)
        self.merges = Merges(model["model"])
        self.trie = WordTrie(self.merges)
        self.lib = Tokenizer.from_str(source)
        self.words = regex.compile(WORDS)
        cutter = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if cutter != WORDS or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in model["added_tokens"]) or model["decoder"]:
            raise ValueError("a model with this module's words, plain added tokens and no decoder is needed")
        self.added = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.token_text = self.merges.text | {i: t for t, i in self.added.items()}
        self.known: dict[str, list[int]] = {}
        self.printed = byte_characters()

    def cut(self, text: str) -> list[str]:
        """Words of a text without added tokens, in the model's byte characters."""
        if AGREED.fullmatch(text):
            return [w if w.isascii() else w.encode().decode("latin-1").translate(self.printed) for w in self.words.findall(text.lower())]
        return [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Words before each added token, and that token; None at the end."""
        at = 0
        for m in self.marks.finditer(text):
            yield self.cut(text[at : m.start()]), self.added[m.group()]
            at = m.end()
        yield self.cut(text[at:]), None

    def learn(self, words: set[str]) -> None:
        """Insert words in their order, which is the trie's depth-first order."""
        if len(self.known) > MAX_WORDS or len(self.trie.last) > MAX_NODES:
            self.known.clear()
            self.trie = WordTrie(self.merges)
        for word in sorted(w for w in words if w not in self.known):
            self.known[word] = (self.trie if len(word) <= LONG_WORD else WordTrie(self.merges)).encode(word)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the texts together are one insertion into the trie, long ones part by part."""
        out: list[list[int]] = [[] for _ in texts]
        held: list[tuple[int, list[str], int | None]] = []
        size = 0

        def flush() -> None:
            self.learn(set(itertools.chain.from_iterable(words for _, words, _ in held)))
            for k, words, mark in held:
                out[k].extend(itertools.chain.from_iterable(map(self.known.__getitem__, words)))
                if mark is not None:
                    out[k].append(mark)
            held.clear()

        for k, text in enumerate(texts):
            for part in word_steps(text or "", STEP_CHARS):
                held.extend((k, *x) for x in self.pieces(part))
                size += len(part)
                if size > STEP_CHARS:
                    flush()
                    size = 0
        flush()
        return out

    def decode(self, ids: list[int]) -> str:
        """Texts of the tokens, spaced; unknown ids are left out, as in the library."""
        try:
            return " ".join(map(self.token_text.__getitem__, ids))
        except KeyError:
            return " ".join(self.token_text[i] for i in ids if i in self.token_text)


def _encoder(df: DataFrame, model_path: str):
    """A function that gives a task its encoder; the file is read on the driver and broadcast."""
    ship(df.sparkSession)
    with open(model_path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: Encoder(source.value)


def bpe_tokens(df: DataFrame, text_col: str = "text", model_path: str = MODEL) -> Column:
    """Struct (ids array<int>, decoded string) of a text column; no shuffle, each task has a trie of the words it meets.

    ids are those of the library for the whole text without special tokens added; strings of added
    tokens in a text give their ids, as there. decoded joins the ids' tokens by spaces, since the model
    has no decoder of its own. Null and empty texts and texts of white space have no ids. Texts of any
    length are encoded whole; repeated rows get equal values; an empty table gives no rows; only the
    text column is read.
    """
    encoder = _encoder(df, model_path)

    def make():
        own = encoder()

        def run(texts: list[str | None]) -> dict[str, list]:
            ids = own.encode(texts)
            return {"ids": ids, "decoded": list(map(own.decode, ids))}

        return run

    return text_column_udf("ids array<int>, decoded string", make)(F.col(text_col))


def encode_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """(id, ids, decoded) of each document; odd rows as in bpe_tokens, identifiers may be null or repeated."""
    return docs.select(F.col(id_col), bpe_tokens(docs, text_col, model_path).alias("t")).select(id_col, "t.ids", "t.decoded")


def decode_bpe(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """(id, text) of encoded rows; null and empty ids give an empty text, unknown ids nothing."""
    encoder = _encoder(rows, model_path)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [own.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
