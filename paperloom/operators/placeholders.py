"""Numbered placeholders: canonical numbering, renaming and replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, values
from ..functions.text import number_matches, strip

KINDS = "LINK|EMAIL|CODE|MATH|TABLE"
BARE = rf"\[\d+:(?:{KINDS})\]"
NAMED = rf"\[(?:[A-Z]+_)?\d+:(?:{KINDS})\]"
DOLLAR = rf"(?i)\$(?:[A-Z]+_)?\d+:(?:{KINDS})\$"


def number_in_document(blocks: DataFrame, pattern: str, kind: str, id_col: str = "doc_id", pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    """Replaces matches by [n:KIND] with n counting through the document; one shuffle by document."""
    n = F.regexp_count(text_col, F.lit(pattern))
    w = Window.partitionBy(id_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_n", n).withColumn("_base", F.sum("_n").over(w) - F.col("_n")).withColumn(text_col, number_matches(F.col(text_col), pattern, kind, F.col("_base"))).drop("_n", "_base")


def canonical_placeholders(entries: DataFrame, id_col: str = "model_id") -> DataFrame:
    """(id, source, token, canonical, value) of entries (id, source, kind, pos, token, value).

    Values are trimmed and blank ones dropped. Equal values of a source and kind share a number;
    numbers follow the first place of each value.
    """
    clean = entries.withColumn("value", strip(F.col("value"))).filter("value <> ''")
    group = Window.partitionBy(id_col, "source", "kind")
    first = F.min("pos").over(Window.partitionBy(id_col, "source", "kind", "value"))
    return (
        clean.withColumn("_first", first)
        .withColumn("_n", F.dense_rank().over(group.orderBy("_first")) - 1)
        .withColumn("canonical", F.concat(F.lit("["), values.citation_tag(F.col("source")), F.lit("_"), F.col("_n").cast("string"), F.lit(":"), F.col("kind"), F.lit("]")))
        .select(id_col, "source", "token", "canonical", "value")
    )


def token_maps(canonical: DataFrame, id_col: str = "model_id") -> DataFrame:
    """(id, source, names): bare token -> canonical token."""
    return canonical.groupBy(id_col, "source").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("token", "canonical")))).alias("names"))


def value_maps(canonical: DataFrame, id_col: str = "model_id") -> DataFrame:
    """(id, values): canonical token -> value."""
    return canonical.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("canonical", "value")))).alias("values"))


def weave(text: Column, pattern: str, replace) -> Column:
    """Each match replaced by an expression of it: the text is cut at the matches and joined again."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(pieces, found, lambda p, t: F.concat(p, F.when(t.isNull(), F.lit("")).otherwise(replace(t)))), "")


def namespace_tokens(text: Column, names: Column) -> Column:
    """Bare tokens become canonical ones where the map knows them."""
    return F.when(names.isNull(), text).otherwise(weave(text, BARE, lambda t: F.coalesce(F.element_at(names, t), t)))


def apply_replacements(text: Column, held: Column) -> Column:
    """Tokens become their values; fenced code gets blank lines around it.

    $...$ spellings follow; of these an unknown one is rewritten in brackets, and a prefix is not
    brought to upper case. An empty map changes nothing.
    """

    def value(token: Column, shown: Column) -> Column:
        got = F.coalesce(F.element_at(held, token), shown)
        fenced = token.endswith(":CODE]") & F.contains(got, F.lit("```"))
        return F.when(fenced, F.concat(F.lit("\n\n"), strip(got), F.lit("\n\n"))).otherwise(got)

    def dollar(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        named = F.concat(F.lit("["), F.substring_index(inner, ":", 1), F.lit(":"), F.upper(F.substring_index(inner, ":", -1)), F.lit("]"))
        return value(named, named)

    once = weave(text, NAMED, lambda t: value(t, t))
    return F.when(held.isNull() | (F.size(held) == 0), text).otherwise(weave(once, DOLLAR, dollar))


def resolve_card_text(text: Column, section: Column, held: Column, payloads: Column) -> Column:
    """V3: legacy tokens, prefixes, values, remaining tokens by section, leftover code, formulas.

    ``held``: canonical token -> value; ``payloads``: JSON text of the lists by source.
    """
    out = values.upgrade_pp(markup.upgrade_legacy_tokens(text))
    out = markup.resolve_section(apply_replacements(out, held), section, payloads)
    return values.normalise_formula(values.strip_unresolved_code(out))
