"""Grouping of spelling variants by bands of letter parities (operator 11).

A word's mask has a bit for each letter, set if the letter stands an odd number of times. One
inserted, deleted or replaced letter flips at most two bits, so of the mask's three bands at least one
is left; and it leaves the word's front or rear half as it was. Words meet in a join on an equal band,
equal length (or one less) and an equal half, and are verified by their distance there. A pair that
shares several such keys is reported at the first of them alone.

A bucket with many words is not joined with itself: its words meet by the text that is left when one
letter is deleted. Such a text and place have at most as many words as there are letters, so the work
stays in proportion to the words whatever they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut

#: Fixed by the contract: what a run of letters is.
RUN = r"[a-zÀ-ÿ]{%d,}"
BANDS = 3
BAND_BITS = 21
#: A bucket of more words is joined by deleted letters instead.
MAX_BUCKET = 256


def planted_words(docs: DataFrame, id_col: str, text_col: str, least_chars: int, slip: int) -> DataFrame:
    """Column word: runs of letters, lower-cased A-Z only; where ``slip`` divides the crc32 of identifier and run, one letter is left out."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN % least_chars), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % slip == 0, without).otherwise(F.col("run")).alias("word"))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, slip: int = 97) -> DataFrame:
    """(word, n) of words of at least ``least_chars`` letters that stand ``least_count`` times or more."""
    words = planted_words(docs, id_col, text_col, least_chars, slip).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """A bit a letter, by the parity of its count, dealt over the bands in turn; letters beyond z share 32 bits."""
    point = lambda c: F.ascii(c)
    index = lambda c: F.when(point(c) < 128, F.pmod(point(c), F.lit(32)) - 1).otherwise(26 + F.pmod(point(c), F.lit(32)))
    bit = lambda c: (index(c) % BANDS) * BAND_BITS + F.floor(index(c) / BANDS)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int"))))


def band(mask: Column, b: int) -> Column:
    return F.shiftrightunsigned(mask, b * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def halves(word: Column, short: Column) -> tuple[Column, Column]:
    """Front and rear half of a word as its partner of ``short`` letters has them, if the other half holds the edit."""
    front = F.floor(short / 2).cast("int")
    return F.substring(word, F.lit(1), front), F.right(word, short - front)


def band_keys(words: DataFrame) -> DataFrame:
    """(word, n, mask, longer, slot, key): each word as one of its length, and as the longer of a pair."""
    masked = words.withColumn("mask", parity_mask(F.col("word")))
    slots = []
    for longer in (0, 1):
        short = F.length("word") - longer
        for b in range(BANDS):
            for side, half in enumerate(halves(F.col("word"), short)):
                slot = b * 2 + side
                slots.append(F.struct(F.lit(bool(longer)).alias("longer"), F.lit(slot).cast("byte").alias("slot"), F.xxhash64(F.lit(slot), short, band(F.col("mask"), b), half).alias("key")))
    return masked.select("word", "n", "mask", F.explode(F.array(*slots)).alias("k")).select("word", "n", "mask", "k.longer", "k.slot", "k.key")


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def band_pairs(keys: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of words one edit apart that share a key; a is the shorter or, of equal lengths, the first in order."""
    left = keys.filter(~F.col("longer")).select("key", "slot", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    right = keys.select("key", "slot", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"))
    la, lb = F.length("a"), F.length("b")
    lengths = F.when(F.col("longer"), lb == la + 1).otherwise((lb == la) & (F.col("a") < F.col("b")))
    flipped = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    first_band = F.when(band(flipped, 0) == 0, 0).when(band(flipped, 1) == 0, 1).when(band(flipped, 2) == 0, 2)
    side = F.when(halves(F.col("a"), la)[0] == halves(F.col("b"), la)[0], 0).otherwise(1)
    met = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.slot") == F.col("r.slot")) & lengths & (F.col("l.slot") == first_band * 2 + side) & one_edit(F.col("a"), F.col("b")))
    return met.select("a", "a_n", "b", "b_n")


def deletion_pairs(words: DataFrame) -> DataFrame:
    """The same pairs of all the given words, by the texts that deleting one letter leaves."""
    left_out = F.col("p")
    gone = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("p")).withColumn("rest", F.concat(F.substring("word", F.lit(1), left_out), F.substring("word", left_out + 2, F.length("word"))))
    a = gone.select("rest", "p", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = gone.select("rest", "p", F.col("word").alias("b"), F.col("n").alias("b_n"))
    replaced = a.join(b, ["rest", "p"]).filter("a < b").select("a", "a_n", "b", "b_n")
    shorter = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"))
    inserted = shorter.join(b.select(F.col("rest").alias("a"), "b", "b_n").distinct(), "a").select("a", "a_n", "b", "b_n")
    return replaced.union(inserted)


def near_pairs(words: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, a_n, b, b_n), once each, of words (word, n) that one inserted, deleted or replaced letter parts."""
    keys = band_keys(words)
    hot = cut(keys.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max_bucket).drop("size"))
    if hot.isEmpty():
        return band_pairs(keys)
    cold = keys.join(hot, ["key", "slot"], "left_anti")
    crowded = cut(keys.join(hot, ["key", "slot"], "left_semi").select("word", "n").distinct())
    return band_pairs(cold).union(deletion_pairs(crowded)).distinct()


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) lead in the end. Each step doubles the way that is known; finished ways are no longer joined."""
    ways = cut(links.select("word", F.col("form").alias("root"), F.lit(False).alias("done")))
    while not ways.filter(~F.col("done")).isEmpty():
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("next_done"))
        moved = ways.filter(~F.col("done")).join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.coalesce("next_done", F.lit(True)).alias("done"))
        ways = cut(moved.union(ways.filter("done")))
    return ways.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, slip: int = 97, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n, of equal ones the first in code-point order, if that n is
    at least twice the word's, else null; ``root`` is where forms lead. Counts double from form to
    form, so ways are short. Null and empty texts have no words; a null identifier counts as the
    empty text in the draw of slips; repeated rows count as often as they stand; texts are read whole;
    an empty table gives no rows; other columns are ignored.
    """
    words = cut(count_words(docs, id_col, text_col, least_chars, least_count, slip))
    pairs = near_pairs(words, max_bucket)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("b_n").alias("form_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("a_n").alias("form_n")))).alias("s")).select("s.*")
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form", "form_n")).alias("best"))
    is_form = F.col("best.form_n") >= 2 * F.col("n")
    formed = cut(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.form")).alias("form"),
            F.when(is_form, F.col("best.form_n")).alias("form_n"),
        )
    )
    roots = last_forms(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
