"""References grouped by label, generation prompts, and assembled cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..sources.calls import Service
from . import placeholders as P
from .lexicon import LABELS, label_table
from .scoring import stored_answers

# --- fixed values: standing texts ------------------------------------------------------------------
EMPTY_TEXT = "[More information needed]"
FAILED, FAILED_CHARS = "Generation Failed", 500
NOT_CONFIGURED, EMPTY_ANSWER = "no generator is configured", "the generator returned an empty text"
PROMPT = """<task>
    Synthesize the provided <reference_text> into a highly readable "{section}" section for a Model Card.
    Adhere strictly to the <section_specifications> and <formatting_rules>.
</task>

<section_specifications>
{spec}
</section_specifications>

<reference_text>
{references}
</reference_text>

<instructions>
    1. Synthesize: Combine info from all sources. If sources disagree, state BOTH values clearly.
    2. Cite: Append a citation tag (e.g., [RP]) to the end of every sentence or bullet point derived from source material.
    3. Placeholders: Preserve tokens like [1:CODE], [2:MATH], [3:EMAIL], or [4:LINK] exactly as they appear.
    4. Missing info: If a specification cannot be met with the provided text, strictly state "No info available".
    5. Formatting: You MUST use markdown lists, bolding for key terms, and avoid blocks of text.
</instructions>

<output_format>
### {section}
- **[Key Term/Concept]:** [Synthesized detail with citation tag]
- **[Key Term/Concept]:** [Synthesized detail with citation tag]
- [Additional scannable details or short sentences...]
</output_format>"""
SOURCES = ("paper", "model_card", "github_readme")


def source_order(source: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, s in enumerate(SOURCES):
        out = out.when(source == s, F.lit(i))
    return out.otherwise(F.lit(len(SOURCES)))


def grouped_references(predictions: DataFrame, key: str = "model_id", text_col: str = "text", label_col: str = "predicted_label", names: DataFrame | None = None, tagged: bool = True) -> DataFrame:
    """(key, section, items), by source and then position.

    With ``tagged`` each item tells its source. ``names`` (key, source, names) renames placeholders
    first. The texts move once, to the group that holds them.
    """
    text = F.col(text_col)
    rows = predictions
    if names is not None:
        rows = rows.join(names, [key, "source"], "left")
        text = P.namespace_tokens(text, F.col("names"))
    if tagged:
        text = F.concat(text, F.lit(" [Source: "), values.citation_tag(F.col("source")), F.lit("]"))
    item = F.struct(source_order(F.col("source")).alias("s"), F.col("pos").alias("p"), text.alias("t"))
    return rows.groupBy(key, F.col(label_col).alias("section")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("items"))


def generation_prompt(section: Column, spec: Column, items: Column) -> Column:
    """G1: the references as bullets, with a section's name and specification, in the standing prompt."""
    bullets = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    out = F.lit(PROMPT)
    for mark, value in (("{section}", section), ("{spec}", spec), ("{references}", bullets)):
        out = F.replace(out, F.lit(mark), value)
    return out


def section_text(section: Column, items: Column, generated: Column, error: Column | None = None) -> Column:
    """An empty section's or a failed one's standing text, else what was generated."""
    head = F.concat(F.lit("### "), section, F.lit("\n\n"))
    failed = F.concat(head, F.lit(f"[{FAILED}: "), F.substring(error, 1, FAILED_CHARS), F.lit("]")) if error is not None else None
    out = F.when(F.size(items) == 0, F.concat(head, F.lit(EMPTY_TEXT)))
    return (out.when(error.isNotNull(), failed) if error is not None else out).otherwise(generated)


def default_section(section: Column, items: Column) -> Column:
    """G2, local: the references themselves as a list, in place of a language model."""
    return F.concat(F.lit("### "), section, F.lit("\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def assemble_cards(references: DataFrame, models: DataFrame, key: str = "model_id", generate=None) -> DataFrame:
    """(key, n_empty, full_markdown): every section in order, joined by blank lines.

    ``generate`` maps (section, items) Columns to a Column.
    """
    wanted = models.select(key).distinct().join(F.broadcast(label_table(models.sparkSession)))
    rows = wanted.join(references.select(key, F.col("section").alias("label"), "items"), [key, "label"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    text = section_text(F.col("label"), F.col("items"), (generate or default_section)(F.col("label"), F.col("items")))
    got = rows.groupBy(key).agg(F.sum((F.size("items") == 0).cast("int")).alias("n_empty"), F.sort_array(F.collect_list(F.struct("label_ord", text.alias("text")))).alias("s"))
    return got.select(key, "n_empty", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("full_markdown"))


def generate_cards(references: DataFrame, models: DataFrame, specs: dict[str, str], generate=None, key: str = "model_id") -> DataFrame:
    """(key, sections, full_markdown, n_failed, success, error), a section for each of ``specs``, in that order.

    ``generate`` is a Service, or maps (section, prompt) Columns to a Column of text, or to a struct
    (text, error); each prompt is asked once and its answer stored. An empty answer is an error too. A section without references has the standing text and asks
    nothing; a failed one shows the error's first characters. Without ``generate`` nothing leaves
    the cluster: no success, and an error instead of a card.
    """
    table = references.sparkSession.createDataFrame([(i, s, t) for i, (s, t) in enumerate(specs.items())], "section_ord int, section string, spec string")
    wanted = models.select(key).distinct().withColumn("_s", F.explode(F.array(*[F.lit(s) for s in specs])))
    rows = wanted.join(F.broadcast(table), F.col("_s") == F.col("section")).drop("_s")  # a handful of constants
    rows = rows.join(references.select(key, "section", "items"), [key, "section"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    if generate is None:
        return models.select(key).distinct().select(key, F.lit(None).cast("map<string,string>").alias("sections"), F.lit("").alias("full_markdown"), F.lit(0).cast("long").alias("n_failed"), F.lit(False).alias("success"), F.lit(NOT_CONFIGURED).alias("error"))
    empty = F.size("items") == 0
    asked = rows.filter(~empty).withColumn("prompt", generation_prompt(F.col("section"), F.col("spec"), F.col("items")))
    told = stored_answers(asked, generate if isinstance(generate, Service) else lambda prompt: generate(F.col("section"), prompt), names=("text", "error"))
    none = rows.filter(empty).select(key, "section_ord", "section", "items", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    asked = told.select(none.columns).union(none)
    text = F.trim(F.coalesce("text", F.lit("")))
    error = F.when(F.size("items") > 0, F.coalesce("error", F.when(text == "", F.lit(EMPTY_ANSWER))))
    shown = asked.withColumn("_error", error).withColumn("_text", section_text(F.col("section"), F.col("items"), text, F.col("_error")))
    got = shown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_ord", "section", F.col("_text").alias("text")))).alias("s"), F.count("_error").alias("n_failed"))
    return got.select(key, F.map_from_entries(F.transform("s", lambda x: F.struct(x["section"], x["text"]))).alias("sections"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("full_markdown"), "n_failed", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))


def label_counts(predictions: DataFrame, key: str = "model_id", label_col: str = "predicted_label") -> DataFrame:
    """A5: paragraphs by source and over all (source null) of each key."""
    return predictions.rollup(key, "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("applied_rerank_rule")).alias("n_reranked") if "applied_rerank_rule" in predictions.columns else F.lit(0).cast("long").alias("n_reranked"), F.countDistinct(label_col).alias("n_labels")).filter(F.col(key).isNotNull())


__all__ = ["LABELS", "assemble_cards", "default_section", "generate_cards", "generation_prompt", "grouped_references", "label_counts", "section_text", "source_order"]
