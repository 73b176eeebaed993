"""Phrase collocation mining by pattern growth over projected occurrences (operator 12).

Words are counted first. Each occurrence of a frequent word that another follows is then projected: a
pointer to it carries the words that follow in its piece, up to the longest phrase and not past an
infrequent word, since no frequent phrase reaches over one. All pointers of a two-word prefix go to one
task and lie together there. A prefix without support ends at once; the pointers of the others are put
in the order of the words that follow, which is the depth-first growth of the prefix: those of each
longer prefix lie together, and their number is its support. A task holds the pointers of a prefix at
a time.

A prefix that holds too many pointers for that, or a large share of all, is dealt by the next longer
prefix, as often as needed, and its own support is summed over tasks. Which prefixes these are is
estimated on a sample; this moves work, never results.

Words are told by a 64-bit hash of language and word. That no two counted words share one is checked,
and another seed taken if they do.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, ship

#: Fixed by the contract: what parts pieces, and what parts words.
BREAKS, BLANKS = r".,;:!?\x0A-\x0D", r"\x20\x09"
UNKNOWN = "und"
LONGEST = 4
#: Bits of the map of frequent words: 2 MB at any size of the corpus; what it lets pass wrongly is dropped by its support.
MAP_BITS = 24
#: A prefix with more than this part of all pointers, or more than so many, is dealt by longer prefixes.
HEAVY_SHARE, MAX_RUN = 1 / 2_000, 2_000_000
#: Words, and least part of all words, of the sample that tells heavy prefixes.
SAMPLE_WORDS, SAMPLE_SHARE = 2_000_000, 1 / 2_000
#: Pointers that a task gathers before it grows prefixes.
BLOCK = 400_000
#: Words a language and languages whose numbers a task keeps, and words turned into pointers at a time.
MAX_CACHE = 200_000
MAX_LANGS = 8
STEP_WORDS = 1_000_000
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


def word_id(lang: Column, word: Column, seed: int) -> Column:
    """xxHash64 of language, word and seed; a word holds no blank, so these can be told apart."""
    return F.xxhash64(F.concat_ws(" ", lang, word, F.lit(str(seed))))


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text)."""
    words = F.explode(F.regexp_extract_all("text", F.lit(f"[^{BLANKS}{BREAKS}]+"), F.lit(0)))
    return rows.select("lang", words.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def numbered(words: DataFrame, least: int) -> tuple[DataFrame, int]:
    """The words (lang, word, n) of at least ``least`` occurrences with their numbers, and the seed under which no word shares one of these."""
    for seed in range(100):
        with_id = words.withColumn("id", word_id(F.col("lang"), F.col("word"), seed))
        shared = with_id.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).filter((F.col("id") == 0) | (F.col("words") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            return with_id.filter(F.col("n") >= least), seed
    raise RuntimeError("no seed tells all words apart")


def frequent_map(words: DataFrame) -> bytes:
    """A bit for the upper MAP_BITS bits of each word's number: at most 2^(MAP_BITS - 6) rows reach the driver."""
    at = F.shiftrightunsigned("id", 64 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    for r in words.groupBy(F.shiftrightunsigned(at, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).collect():
        out[r["slot"]] = r["bits"]
    return out.astype("<i8").tobytes()


def prefix_hashes(w: np.ndarray) -> np.ndarray:
    """A hash of each beginning of each row of words."""
    out = np.empty(w.shape, np.uint64)
    h = np.zeros(len(w), np.uint64)
    for k in range(w.shape[1]):
        h = (h ^ w[:, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out[:, k] = h
    return out


class Numbers(dict):
    """Numbers of one language's words, found when first asked for; 0 for breaks and words that the map leaves out."""

    def __init__(self, lang: str, seed: int, bits: bytes):
        self.front, self.rear, self.bits = f"{lang} ", f" {seed}", bits

    def __missing__(self, word: str) -> int:
        h = 0
        if word[0] not in ".,;:!?\n\v\f\r":
            h = xxhash.xxh64_intdigest(f"{self.front}{word}{self.rear}".encode(), 42)
            at = h >> 64 - MAP_BITS
            h = 0 if not self.bits[at >> 3] >> (at & 7) & 1 else h - (1 << 64) if h >> 63 else h
        if len(self) >= MAX_CACHE:
            self.clear()
        self[word] = h
        return h


def projected(batch: pa.RecordBatch, seed: int, bits: bytes, known: dict[str, Numbers]) -> Iterator[np.ndarray]:
    """Pointers of a batch (lang, text): the LONGEST numbers from each frequent word that another follows, 0 from the first break on."""
    cut_words = regex.compile(f"[{BREAKS}]+|[^{BLANKS}{BREAKS}]+")
    held: list[int] = []
    for lang, text in zip(batch.column(0), batch.column(1)):
        name, text = lang.as_py(), text.as_py()
        if name not in known:
            if len(known) >= MAX_LANGS:
                known.clear()
            known[name] = Numbers(name, seed, bits)
        number = known[name].__getitem__
        if len(text) <= STEP_WORDS:
            held += map(number, cut_words.findall(text))
        else:
            found = cut_words.finditer(text)
            while part := [m.group() for m in itertools.islice(found, STEP_WORDS)]:
                held += map(number, part)
                if len(held) > STEP_WORDS:
                    yield pointers(held)
                    held = held[1 - LONGEST :]
        held += [0] * LONGEST
        if len(held) > STEP_WORDS:
            yield pointers(held)
            held = [0] * LONGEST
    if held:
        yield pointers(held)


def pointers(held: list[int]) -> np.ndarray:
    a = np.array(held, np.int64)
    at = np.flatnonzero((a[: 1 - LONGEST] != 0) & (a[1 : 2 - LONGEST] != 0))
    out = np.stack([a[at + k] for k in range(LONGEST)], 1)
    for k in range(1, LONGEST):
        out[out[:, k - 1] == 0, k] = 0
    return out


def summed(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each stands."""
    w = w[np.lexsort(w.T[::-1])]
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]).any(1)])[: len(w)])
    return w[new], np.diff(np.append(new, len(w)))


def dealt(w: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointers with the length of the prefix that they are dealt by, the shortest of two words or more that is not heavy, and their numbers.

    Equal pointers are summed where even their three first words are heavy.
    """
    n, depth = np.ones(len(w), np.int64), np.full(len(w), 2)
    if not len(heavy) or not len(w):
        return w, depth, n
    h = prefix_hashes(w)
    for k in range(1, LONGEST - 1):
        depth += (depth == k + 1) & np.isin(h[:, k], heavy)
    deep = depth == LONGEST
    if deep.any():
        again, counts = summed(w[deep])
        w, n, depth = np.concatenate([w[~deep], again]), np.concatenate([n[~deep], counts]), np.concatenate([depth[~deep], np.full(len(again), LONGEST)])
    return w, depth, n


def whole_runs(blocks: Iterator[tuple[np.ndarray, ...]], size: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of columns, in order of the first, put together so that equal values of it never lie in two; of ``size`` rows or more, but for the last."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for block in blocks:
        held.append(block)
        rows += len(block[0])
        if rows < size or held[0][0][0] == block[0][-1]:
            continue
        whole = [np.concatenate(c) for c in zip(*held)]
        stop = int(np.flatnonzero(whole[0][1:] != whole[0][:-1])[-1]) + 1
        yield tuple(c[:stop] for c in whole)
        held = [tuple(c[stop:] for c in whole)]
        rows = len(held[0][0])
    if rows:
        yield tuple(np.concatenate(c) for c in zip(*held))


def grown(s: np.ndarray, w: np.ndarray, n: np.ndarray, depth: np.ndarray, heavy: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of two words and more with their support, of whole runs of pointers by what they are dealt by.

    Phrases of a support under ``least`` go, but for those whose prefixes are all heavy: their pointers
    lie in several tasks, and this is but a part of their support.
    """
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    enough = np.repeat(np.add.reduceat(n, first) >= least, np.diff(np.append(first, len(s)))) | (depth > 2)
    w, n = w[enough], n[enough]
    order = np.lexsort(w.T[::-1])
    w, n = w[order], n[order]
    for k in range(2, LONGEST + 1):
        there = w[:, k - 1] != 0
        w, n = w[there], n[there]
        if not len(w):
            return
        first = np.flatnonzero(np.concatenate([[True], (w[1:, :k] != w[:-1, :k]).any(1)]))
        sums, runs = np.add.reduceat(n, first), np.zeros((len(first), LONGEST), np.int64)
        runs[:, :k] = w[first, :k]
        stay = sums >= least
        if len(heavy) and k < LONGEST:
            h = prefix_hashes(runs)
            stay |= np.all([np.isin(h[:, j], heavy) for j in range(1, k)], axis=0)
        yield runs[stay], sums[stay]


def _batch(w: np.ndarray, n: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    columns = {name: pa.array(w[:, k], pa.int64()) for k, name in enumerate(WORDS)} | {"n": pa.array(n, pa.int64())} | more
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def heavy_prefixes(drawn: DataFrame, share: float, seed: int, bits, heavy_share: float) -> np.ndarray:
    """Hashes of the prefixes that hold more than ``heavy_share`` or MAX_RUN of all pointers, of which the rows ``drawn`` give ``share``.

    A prefix of two or three words is 8 bytes for each MAX_RUN pointers at least, or there are fewer than
    1 / heavy_share of a length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        for batch in batches:
            for w in projected(batch, seed, bits.value, known):
                h, n = [np.zeros(1, np.int64)], [np.array([len(w)])]
                for k in range(1, LONGEST - 1):
                    one, many = np.unique(prefix_hashes(w)[:, k], return_counts=True)
                    some = many > min(len(w) * heavy_share / 4, 8)
                    h.append(one[some].view(np.int64))
                    n.append(many[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h), pa.int64()), pa.array(np.concatenate(n), pa.int64())], names=["h", "n"])

    told = cut(drawn.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    pointers_ = told.filter("h = 0").agg(F.sum("n")).first()[0] or 0
    least = min(pointers_ * heavy_share, MAX_RUN * share)
    return np.sort(np.array([r["h"] for r in told.filter((F.col("h") != 0) & (F.col("n") > least)).collect()], np.int64)).view(np.uint64)


def frequent_phrases(rows: DataFrame, drawn: DataFrame, share: float, seed: int, bits: bytes, least: int, heavy_share: float) -> DataFrame:
    """(w1, w2, w3, w4, n): phrases of 2 to 4 words that stand ``least`` times or more; words that a phrase lacks are 0."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(bits)
    heavy = spark.sparkContext.broadcast(heavy_prefixes(drawn, share, seed, held, heavy_share))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        for batch in batches:
            for found in projected(batch, seed, held.value, known):
                w, depth, n = dealt(found, heavy.value)
                yield _batch(w, n, depth=pa.array(depth, pa.int32()))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ((b.column("s").to_numpy(), np.stack([b.column(name).to_numpy() for name in WORDS], 1), b.column("n").to_numpy(), b.column("depth").to_numpy()) for b in batches if b.num_rows)
        for whole in whole_runs(blocks):
            for w, n in grown(*whole, heavy.value, least):
                yield _batch(w, n)

    words = ", ".join(f"{w} long" for w in WORDS)
    by = F.when(F.col("depth") == 2, F.xxhash64("w1", "w2")).when(F.col("depth") == 3, F.xxhash64("w1", "w2", "w3")).otherwise(F.xxhash64(*WORDS))
    # the hash is not shuffled; a sort by one number needs no comparison of rows
    dealt_out = rows.mapInArrow(project, f"{words}, n long, depth int").repartition(by).withColumn("s", by).sortWithinPartitions("s")
    found = dealt_out.mapInArrow(grow, f"{words}, n long")
    return found.groupBy(*WORDS).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def part(start: int, length: int) -> list[Column]:
    """The words of a phrase from ``start`` on, ``length`` of them, as a phrase's columns."""
    return [(F.col(WORDS[start + k]) if k < length else F.lit(0).cast("long")).alias(w) for k, w in enumerate(WORDS)]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2_000, cover_percent: int = 80, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per kept phrase: lang, rank, phrase, a, l, r, n, score; each language's ``top`` by score, a and phrase.

    a is a phrase's support, l and r those of the parts of its lowest-scoring cut, n its language's
    words; score is floor(2000000 a / (l + r)), in exact decimals. A phrase of which ``cover_percent``
    lies within one longer phrase goes. Null and empty texts have no words, a null language is und;
    repeated rows count as often as they stand; texts are read whole, in parts; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    lowered = lambda df: df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), ascii_lower(F.col(text_col)).alias("text"))
    rows = lowered(docs)
    counted = cut(count_words(rows))
    totals = cut(counted.groupBy("lang").agg(F.sum("n").alias("total")))
    total = totals.agg(F.sum("total")).first()[0] or 0
    words, seed = numbered(counted, least)
    words = cut(words)
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_WORDS / max(total, 1)))
    # drawn before texts are lower-cased, by their beginnings and lengths
    drawn = lowered(docs.filter(F.pmod(F.xxhash64(F.substring(text_col, 1, 64), F.length(text_col)), F.lit(1_000_000)) < int(share * 1_000_000)))
    phrases = cut(frequent_phrases(rows, drawn, share, seed, frequent_map(words), least, heavy_share))

    length = sum(F.when(F.col(w) != 0, 1).otherwise(0) for w in WORDS)
    support = phrases.select(*WORDS, F.col("n").alias("f")).union(words.select(F.col("id").alias("w1"), *part(0, 0)[1:], F.col("n").alias("f")))
    asked = []
    for m in range(2, LONGEST + 1):
        for k in range(1, m):
            asked += [F.when(length == m, F.struct(F.lit(k).alias("k"), F.lit(i).alias("rest"), F.struct(*part(*x)).alias("key"))) for i, x in enumerate([(0, k), (k, m - k)])]
    sought = phrases.select(F.struct(*WORDS).alias("p"), F.col("n").alias("a"), F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("q")).select("p", "a", "q.k", "q.rest", "q.key.*")
    met = sought.join(support, WORDS).groupBy("p").agg(F.first("a").alias("a"), *[F.max(F.when((F.col("k") == k) & (F.col("rest") == i), F.col("f"))).alias(f"{'lr'[i]}{k}") for k in range(1, LONGEST) for i in (0, 1)])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(2000000 * CAST(a AS DECIMAL(20,0))) DIV (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{k} AS DECIMAL(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = met.select("p", "a", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("c")).select("p", "a", "c.score", "c.l", "c.r")

    inner = [F.when(length > m, F.struct(*part(at, m))) for m in range(2, LONGEST) for at in range(LONGEST - m + 1)]
    within = phrases.filter(F.col("w3") != 0).select(F.col("n").alias("longer"), F.explode(F.array_distinct(F.filter(F.array(*inner), lambda x: x.isNotNull()))).alias("p"))
    within = within.filter(F.col(f"p.{WORDS[0]}") != 0).groupBy("p").agg(F.max("longer").alias("longer"))
    left = scored.join(within, "p", "left").filter(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < cover_percent * wide("a"))).drop("longer")

    spelt = left.select("*", F.posexplode(F.filter(F.array(*[F.col(f"p.{w}") for w in WORDS]), lambda x: x != 0)).alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    named = spelt.groupBy("p").agg(*[F.first(c).alias(c) for c in ("lang", "a", "l", "r", "score")], F.array_join(F.sort_array(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
