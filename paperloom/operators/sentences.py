"""A sentence splitter that learns from its own corpus.

Which periods end a sentence is told by statistics of the text alone, after Kiss and Strunk,
"Unsupervised Multilingual Sentence Boundary Detection" (2006): an abbreviation stands with a period far
more often than without, is short, and may hold periods inside; a pair of words over a period that come
together more often than chance is one expression; some words start sentences more often than chance;
and a word that is otherwise written small, but large after a period, tells that a sentence begins.

Counts are Spark aggregates over all texts, and every abbreviation, starter and pair that the statistics tell
counts. What decides periods of the trained texts themselves is broadcast where it is small, else joined to them.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import ship

# --- fixed values of the paper: thresholds of the statistics -----------------------------------------
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
PERIOD_RATE = 0.99
#: Rows and characters of what is sent whole to every executor; what is more is joined.
SENT = (500_000, 8_000_000)
NUMBER = "##"
WHITE = " \t\n\x0b\f\r"
TOKEN = r"[^ \t\n\x0B\f\r]+"
AROUND = r"""^[("'\[{<*_“‘«„]+|[)"'\]}>*_,;:!?”’»]+$"""
#: What a word needs for its core to end with a period, or to begin large.
DOTTED = r"""\.[)"'\]}>*_,;:!?”’»]*$"""
LARGE = r"""^[("'\[{<*_“‘«„]*\p{Lu}"""
BOUNDARY = r"(?<=[.!?])[ \t\n\x0B\f\r]+"
LOWER, UPPER_INSIDE = 1, 2


def raw_words(text: Column) -> Column:
    """The words of a text that hold a letter or digit, as they stand."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def core(raw: Column) -> Column:
    """A word without brackets, quotes and marks around it."""
    return F.regexp_replace(raw, AROUND, "")


def word_type(kind: Column) -> Column:
    """The type of a word's core: small-lettered and without a final period; numbers are one type."""
    bare = F.regexp_replace(kind, r"\.$", "")
    return F.when(bare.rlike(r"^[0-9][0-9.,]*$"), F.lit(NUMBER)).otherwise(F.lower(bare))


def has_dot(kind: Column) -> Column:
    return F.endswith(kind, F.lit("."))


def is_upper(kind: Column) -> Column:
    return kind.rlike(r"^\p{Lu}")


def tokens(text: Column) -> Column:
    """Words in order as structs (type, dot, upper), told from each word's core."""
    return F.transform(F.transform(raw_words(text), core), lambda t: F.struct(word_type(t).alias("type"), has_dot(t).alias("dot"), is_upper(t).alias("upper")))


def is_initial(kind: Column) -> Column:
    return (F.length(kind) == 1) & kind.rlike(r"\p{L}")


def log_likelihood(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's statistic of b given a, as used for pairs and starters: a, b and both are counts out of ``total``."""
    a, b, both, total = (x.cast("double") for x in (a, b, both, total))
    p, p1, p2 = F.try_divide(b, total), F.try_divide(both, a), F.try_divide(b - both, total - a)
    part = lambda k, rest, q: F.when((q > 0) & (q < 1), k * F.log(q) + rest * F.log(1 - q)).otherwise(F.lit(0.0))
    return -2 * (part(both, a - both, p) + part(b - both, total - a - b + both, p) - part(both, a - both, p1) - part(b - both, total - a - b + both, F.coalesce(p2, F.lit(0.0))))


def abbreviation_score(kind: Column, with_dot: Column, without: Column, dots: Column, total: Column) -> Column:
    """Likelihood ratio of a period after the type, times factors for shortness, periods inside and uses without a period."""
    n, k = (with_dot + without).cast("double"), with_dot.cast("double")
    p = F.try_divide(dots.cast("double"), total)
    ratio = -2 * (k * F.log(p) + (n - k) * F.log(1 - p) - (k * F.log(F.lit(PERIOD_RATE)) + (n - k) * F.log(F.lit(1 - PERIOD_RATE))))
    inside = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit(""))) + 1
    letters = F.length(kind) - inside + 2
    return ratio * F.exp(-letters) * inside * F.pow(letters.cast("double"), -without.cast("double"))


@dataclass(frozen=True)
class SentenceModel:
    """What is known of words before and after periods."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    pairs: frozenset[tuple[str, str]] = frozenset()
    spelling: dict[str, int] = field(default_factory=dict)

    def begins(self, kind: str, upper: bool) -> bool | None:
        """Whether a word's spelling tells that a sentence begins; None where it tells nothing."""
        if not upper:
            return False
        seen = self.spelling.get(kind, 0)
        return True if seen & LOWER and not seen & UPPER_INSIDE else None

    def cuts(self, before: str, after: str) -> bool:
        """Whether a sentence ends between two words, of which the first ends with one of . ! ?"""
        left, dot, _ = plain_token(before)
        if not dot or not left:
            return True
        initial, number = len(left) == 1 and left.isalpha(), left == NUMBER
        abbreviation = left in self.abbreviations
        if not (abbreviation or initial or number):
            return True
        right, _, upper = plain_token(after)
        if (left, right) in self.pairs:
            return False
        begins = self.begins(right, upper)
        if abbreviation and not initial:
            return upper and right in self.starters or begins is True
        if begins is None:
            return not (initial and not self.spelling.get(right, 0) & LOWER)
        return begins

    def split(self, text: str) -> list[str]:
        """Sentences; where the model tells that none ends, the parts are joined by a space."""
        out: list[list[str]] = []
        last = ""
        for part in _BOUNDARY.split(text):
            if first := _TOKEN.search(part):
                if out and not self.cuts(last, first.group()):
                    out[-1].append(part)
                else:
                    out.append([part])
                end = part.rstrip(WHITE)
                last = end[max(map(end.rfind, WHITE)) + 1 :]
        return [" ".join(parts) for parts in out]


_BOUNDARY, _AROUND, _TOKEN = re.compile(BOUNDARY), re.compile(AROUND), re.compile(TOKEN)


@lru_cache(200_000)
def plain_token(raw: str) -> tuple[str, bool, bool]:
    """(type, dot, upper) of one word, as ``tokens`` has it; an empty type where no letter or digit is."""
    core = _AROUND.sub("", raw)
    if not any(c.isalnum() for c in core):
        return "", False, False
    bare = core.removesuffix(".")
    kind = NUMBER if re.fullmatch("[0-9][0-9.,]*", bare) else bare.lower()
    return kind, core.endswith("."), unicodedata.category(core[0]) == "Lu"


def is_small(*tables: DataFrame) -> bool:
    """Whether all rows of tables of words are within SENT together."""
    rows = characters = 0
    for df in tables:
        words = [F.length(f.name) for f in df.schema if f.dataType.typeName() == "string"]
        got = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(words, F.lit(0))), F.lit(0))).first()
        rows, characters = rows + got[0], characters + got[1]
    return rows <= SENT[0] and characters <= SENT[1]


def sent(df: DataFrame) -> DataFrame:
    """A stored table, marked to be broadcast where it is small."""
    return F.broadcast(df) if is_small(df) else df


@dataclass(frozen=True)
class SentenceStatistics:
    """Tables of the training: (type, n_dot, n_plain, score), (type, n_at_break, n, score), (first, second, both, large, score), (type, n, seen, large).

    ``large``: whether the last word stood large over such a period, without which it decides nothing in these texts.
    """

    abbreviations: DataFrame
    starters: DataFrame
    pairs: DataFrame
    spelling: DataFrame

    def model(self, most: tuple[int, int, int, int] | None = None) -> SentenceModel:
        """All of each table, on the driver; with ``most``, the best rows of each alone, for a caller who asks for a smaller model."""

        def rows(df: DataFrame, k: int, *by: str) -> list:
            return (df.orderBy(*[F.col(c).desc() if c in ("score", "n") else F.col(c) for c in by]).limit(most[k]) if most else df).collect()

        return SentenceModel(
            frozenset(r["type"] for r in rows(self.abbreviations, 0, "score", "type")),
            frozenset(r["type"] for r in rows(self.starters, 1, "score", "type")),
            frozenset((r["first"], r["second"]) for r in rows(self.pairs, 2, "score", "first", "second")),
            {r["type"]: r["seen"] for r in rows(self.spelling, 3, "n", "type")},
        )

    def deciding(self) -> SentenceStatistics:
        """The rows that decide a period of the trained texts themselves: a small word after it ends no sentence, whatever else is known."""
        told = lambda df: cut(df.filter("large"))
        large = self.spelling.filter("large")
        return SentenceStatistics(self.abbreviations, cut(self.starters.join(large.select("type"), "type", "left_semi")), told(self.pairs), cut(large.filter(F.col("seen").bitwiseAND(LOWER) > 0)))

    def is_small(self) -> bool:
        return is_small(self.abbreviations, self.starters, self.pairs, self.spelling)


def sentence_statistics(docs: DataFrame, text_col: str = "text") -> SentenceStatistics:
    """Statistics of all texts, from two scans: of words, then, with the abbreviations known, of pairs of words.

    Null and empty texts have no words. Words are counted as they stand, and each different one is told its
    type once. Of pairs only those over a period are moved: those after an abbreviation, initial or number,
    and the words after a plain period, and large words inside a sentence.
    """
    spark = docs.sparkSession
    words = docs.select(raw_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    # outer explodes: an inner one would cut every text once more, to tell that it has words
    different = words.select(F.explode_outer("w").alias("raw")).filter("raw is not null").groupBy("raw").count().withColumn("core", core(F.col("raw")))
    told = different.select(word_type(F.col("core")).alias("type"), has_dot(F.col("core")).alias("dot"), is_upper(F.col("core")).alias("upper"), "count")
    of = lambda condition: F.sum(F.when(condition, F.col("count")).otherwise(0))
    counts = cut(told.groupBy("type").agg(of(F.col("dot")).alias("n_dot"), of(~F.col("dot")).alias("n_plain"), of(~F.col("upper")).alias("n_lower")))
    total, dots = (x or 0 for x in counts.agg(F.sum(F.col("n_dot") + F.col("n_plain")), F.sum("n_dot")).first())
    known = (F.col("type") != NUMBER) & ~is_initial(F.col("type")) & F.col("type").rlike(r"\p{L}")
    score = abbreviation_score(F.col("type"), F.col("n_dot"), F.col("n_plain"), F.lit(dots), F.lit(total))
    abbreviations = cut(counts.filter(known & (F.col("n_dot") > 0)).select("type", "n_dot", "n_plain", score.alias("score")).filter(F.col("score") >= ABBREVIATION))

    # a row a pair that is kept; plain pairs tell no more than that a word was written large inside a sentence
    pairs = words.select(F.explode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p")).select("p.a", "p.b")
    after = pairs.filter(F.col("b").isNotNull() & (F.col("a").contains(".") & F.col("a").rlike(DOTTED) | F.col("b").rlike(LARGE)))
    after = after.select(core(F.when(F.col("a").contains("."), F.col("a"))).alias("core"), "b").select(F.when(has_dot(F.col("core")), word_type(F.col("core"))).alias("dotted"), "b")
    names = abbreviations.select(F.col("type").alias("met"), F.lit(True).alias("known"))
    if is_small(names):
        after = after.withColumn("count", F.lit(1)).join(F.broadcast(names), F.col("dotted") == F.col("met"), "left")
    else:  # equal pairs are one row before they are moved, and words after no period are dealt by themselves
        after = after.groupBy("dotted", "b").count().withColumn("key", F.coalesce("dotted", F.concat(F.lit(" "), "b"))).join(names, F.col("key") == F.col("met"), "left")
    after = after.withColumn("known", F.coalesce("known", F.lit(False)))
    dot = F.col("dotted").isNotNull()
    ends = dot & ~F.col("known")
    open_ = F.col("known") | is_initial(F.col("dotted")) | (F.col("dotted") == NUMBER)
    kept = after.select(F.when(dot & open_, F.col("dotted")).alias("first"), "b", ends.alias("ends"), F.when(ends & ~open_, True).otherwise(False).alias("starts"), (~dot).alias("inside"), "count")
    kept = kept.groupBy("first", "b", "ends", "starts", "inside").agg(F.sum("count").alias("count")).withColumn("core", core(F.col("b"))).withColumn("upper", is_upper(F.col("core")))
    kept = kept.select("first", word_type(F.col("core")).alias("second"), "ends", "starts", (F.col("inside") & F.col("upper")).alias("inside"), (F.col("first").isNotNull() & F.col("upper")).alias("large"), "count").filter(F.col("first").isNotNull() | F.col("ends") | F.col("inside"))
    seen = cut(kept.groupBy("first", "second").agg(F.sum("count").alias("both"), of(F.col("ends")).alias("ends"), of(F.col("starts")).alias("n_at_break"), of(F.col("inside")).alias("inside"), F.max("large").alias("large")))
    breaks = seen.agg(F.sum("ends")).first()[0] or 0
    count = counts.select(F.col("type"), (F.col("n_dot") + F.col("n_plain")).alias("n"), "n_lower")

    at_break = seen.groupBy(F.col("second").alias("type")).agg(F.sum("n_at_break").alias("n_at_break"), F.max(F.col("inside") > 0).alias("inside"), F.max(F.col("first").isNotNull()).alias("follows"), F.max("large").alias("large")).join(count, "type")
    at_break = cut(at_break)
    starts = at_break.filter((F.col("n_at_break") > 0) & F.col("type").rlike(r"^\p{L}+$")).withColumn("score", log_likelihood(F.lit(breaks), F.col("n"), F.col("n_at_break"), F.lit(total)))
    starters = cut(starts.filter((F.col("score") >= STARTER) & (F.lit(total) * F.col("n_at_break") > F.col("n") * breaks)).select("type", "n_at_break", "n", "score"))

    over = seen.filter("first is not null").select("first", "second", "both", "large").join(sent(starters.select(F.col("type").alias("second"))), "second", "left_anti")
    over = over.join(count.select(F.col("type").alias("first"), F.col("n").alias("n1")), "first").join(count.select(F.col("type").alias("second"), F.col("n").alias("n2")), "second")
    chance = over.filter((F.col("n1") > 1) & (F.col("n2") > 1) & (F.col("both") > 1) & (F.col("both") <= F.least("n1", "n2"))).withColumn("score", log_likelihood(F.col("n1"), F.col("n2"), F.col("both"), F.lit(total)))
    pairs = chance.filter((F.col("score") >= COLLOCATION) & (F.lit(total) * F.col("both") > F.col("n1") * F.col("n2"))).select("first", "second", "both", "large", "score")
    spelling = at_break.filter("follows").select("type", "n", "large", (F.when(F.col("n_lower") > 0, LOWER).otherwise(0) + F.when(F.col("inside"), UPPER_INSIDE).otherwise(0)).alias("seen"))
    return SentenceStatistics(abbreviations, starters, pairs, spelling)


def trained_sentences(model: SentenceModel, text: Column) -> Column:
    """Array of sentences of a text, by a trained model. Null and blank texts have none."""
    spark = SparkSession.active()
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        split = held.value.split
        return texts.map(lambda t: split(t) if isinstance(t, str) else [])

    return run(text)


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentences) of documents, by a model trained on these."""
    known = sentence_statistics(docs, text_col).deciding()
    if known.is_small():
        return docs.select(id_col, trained_sentences(known.model(), F.col(text_col)).alias("sentences"))
    return joined_sentences(docs, known, id_col, text_col)


def joined_sentences(docs: DataFrame, known: SentenceStatistics, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What trained_sentences gives, with tables of any size: they are joined to the periods between parts of the texts.

    Texts are stored with a number a row, by which the parts that go on come back to them. Python holds one text's parts.
    """
    ship(docs.sparkSession)
    rows = cut(docs.select(id_col, F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row")))
    asked = rows.select("_row", F.explode(open_ends(F.col("_text"))).alias("x")).select("_row", "x.*")
    # where the word before may be none's last, a small word after it begins no sentence; large ones are met once each
    at = asked.join(sent(known.abbreviations.select(F.col("type").alias("left"), F.lit(True).alias("known"))), "left", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    at = at.filter(F.col("known") | F.col("loose"))
    met = at.filter("upper").select("left", "right").distinct()
    met = met.join(known.pairs.select(F.col("first").alias("left"), F.col("second").alias("right"), F.lit(True).alias("paired")), ["left", "right"], "left")
    met = met.join(known.starters.select(F.col("type").alias("right"), F.lit(True).alias("starter")), "right", "left").join(known.spelling.select(F.col("type").alias("right"), "seen"), "right", "left")
    met = met.select("left", "right", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("paired", "starter")], F.coalesce("seen", F.lit(0)).alias("seen"))
    large = at.filter("upper").join(met, ["left", "right"])
    begins, small = F.col("seen") == LOWER, F.col("seen").bitwiseAND(LOWER) > 0
    cuts = ~F.col("paired") & F.when(F.col("known") & ~F.col("initial"), F.col("starter") | begins).otherwise(begins | ~F.col("initial") | small)
    on = at.filter("not upper").select("_row", "at").union(large.filter(~cuts).select("_row", "at")).groupBy("_row").agg(F.collect_list("at").alias("_on"))

    @F.pandas_udf("array<string>")
    def put(texts: pd.Series, on: pd.Series) -> pd.Series:
        return pd.Series([joined_parts(t, set(() if a is None else map(int, a))) if isinstance(t, str) else [] for t, a in zip(texts, on)], dtype=object)

    return rows.join(on, "_row", "left").select(id_col, put(F.col("_text"), F.col("_on")).alias("sentences"))


def text_parts(text: str) -> list[tuple[str, str, str]]:
    """(part, first word, last word) of what stands between possible ends of sentences, blank parts left out."""
    out = []
    for part in _BOUNDARY.split(text):
        if first := _TOKEN.search(part):
            end = part.rstrip(WHITE)
            out.append((part, first.group(), end[max(map(end.rfind, WHITE)) + 1 :]))
    return out


def joined_parts(text: str, on: set[int]) -> list[str]:
    """Sentences of a text whose parts of the numbers ``on`` go on with the one before."""
    out: list[list[str]] = []
    for k, (part, _, _) in enumerate(text_parts(text)):
        if k in on:
            out[-1].append(part)
        else:
            out.append([part])
    return [" ".join(parts) for parts in out]


def open_ends(text: Column) -> Column:
    """The parts of a text that follow a word with a period, by number, with the types of the words before and after."""

    def of(text: str | None) -> list[dict]:
        parts, out = text_parts(text or ""), []
        for k in range(1, len(parts)):
            left, dot, _ = plain_token(parts[k - 1][2])
            if dot and left:
                right, _, upper = plain_token(parts[k][1])
                initial = len(left) == 1 and left.isalpha()
                out.append({"at": k, "left": left, "right": right, "upper": upper, "initial": initial, "loose": initial or left == NUMBER})
        return out

    @F.pandas_udf("array<struct<at:int,left:string,right:string,upper:boolean,initial:boolean,loose:boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of, na_action=None)

    return run(text)
