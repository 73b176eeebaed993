"""Checklist scores from a scorer's answers, and the prompts that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..lineage import cut
from ..sources.calls import Service
from .lexicon import CHECKLIST, checklist_table

# --- fixed values: the prompt's wording -----------------------------------------------------------
INSTRUCTIONS = """<instructions>
For each item in the <checklist>:
1. Identify the requirement.
2. Search <reference_text> for evidence.
3. Extract a direct quote if found.
4. Detailed reasoning for your score based on the evaluation rubric.
5. Output the result in the JSON format specified in the output schema.
</instructions>

<constraints>
1. Source: Base the answer ONLY on the reference_text.
2. Completeness: You MUST evaluate ALL points in the checklist.
3. Mapping: Maintain the exact order and Point Numbers provided in the checklist.
4. Handling File Names: If a file name (e.g., requirements.txt, data.csv) appears in reference_text and standard conventions suggest it contains the required info, treat this as Score 1 (Pass).
5. Handling Placeholders: If placeholders like [1:CODE], [2:MATH], or [3:LINK] appear and surrounding text confirms they represent the required item, treat this as Score 1 (Pass).
</constraints>"""
#: What a scorer is asked to return. Points run from 1 to 22; scores are 0, 0.5 or 1.
RESPONSE_SCHEMA = "evaluations array<struct<point_number:int,evidence_quote:string,reasoning:string,score:double>>"
NO_OUTPUT = "No structured output returned."
#: What an evaluation without a scorer states.
NOT_CONFIGURED = "no scorer is configured"


def python_list(items: Column) -> Column:
    """Spelling of a list of strings as a Python literal: quotes chosen and escaped as repr() does."""

    def one(s: Column) -> Column:
        t = F.replace(F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        single, double = F.contains(s, F.lit("'")), F.contains(s, F.lit('"'))
        return F.when(single & ~double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))


def build_prompts(references: DataFrame, key: str = "model_id", files: DataFrame | None = None) -> DataFrame:
    """(key, section_ord, section, prompt) of every checklist section.

    ``references``: (key, section, items). ``files``: (key, files) joins the Files section.
    """
    spark = references.sparkSession
    items = checklist_table(spark).groupBy("section_ord", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_ord", "item"))), lambda x: x["item"]), "\n").alias("checklist"))
    keys = references.select(key).distinct() if files is None else references.select(key).union(files.select(key)).distinct()
    none = F.array().cast("array<string>")
    rows = keys.join(F.broadcast(items)).join(references.select(key, "section", "items"), [key, "section"], "left")
    refs = F.coalesce("items", none)
    if files is not None:
        rows = rows.join(files, key, "left")
        refs = F.when(F.col("section") == "Files", F.concat(refs, F.coalesce("files", none))).otherwise(refs)
    prompt = F.concat(F.lit("<checklist>\n"), F.col("checklist"), F.lit("\n</checklist>\n\n<reference_text>\n"), python_list(refs), F.lit("\n</reference_text>\n\n" + INSTRUCTIONS))
    return rows.select(key, "section_ord", "section", prompt.alias("prompt"))


def stub_answers(prompts: DataFrame, answer=None) -> DataFrame:
    """Adds the scorer's answer to each prompt. ``answer`` maps a Column to a Column; without one
    every answer is empty, so that nothing leaves the cluster."""
    return prompts.withColumn("answer", answer(F.col("prompt")) if answer else F.lit(""))


def read_answers(answers: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, section, ord, point_number, evidence_quote, reasoning, score) of the answers' items."""
    return answers.select(key, "section", F.posexplode(values.parse_scorer_output(F.col("answer"))).alias("ord", "e")).select(key, "section", "ord", "e.*")


def fill_and_score(items: DataFrame, models: DataFrame, key: str = "model_id") -> DataFrame:
    """Checklist items of every model; a section without any item gets all its points at 0.

    Single missing points of a section that has items are not filled.
    """
    checklist = checklist_table(items.sparkSession)
    scored = items.select(key, "section", F.col("ord").cast("int").alias("ord"), "point_number", "evidence_quote", "reasoning", values.score_or_zero(F.col("score").cast("string")).alias("score"))
    wanted = models.select(key).distinct().join(F.broadcast(checklist.select("section", "item_ord", "item")))
    missing = wanted.join(scored.select(key, "section").distinct(), [key, "section"], "left_anti")
    zero = missing.select(key, "section", F.col("item_ord").alias("ord"), values.point_number(F.col("item")).alias("point_number"), F.lit("None").alias("evidence_quote"), F.lit(NO_OUTPUT).alias("reasoning"), F.lit(0.0).alias("score"))
    return scored.unionByName(zero)


def stored_answers(prompts: DataFrame, score=None, by: str = "prompt", names: tuple[str, ...] = ("answer", "error")) -> DataFrame:
    """Prompts with their answer and error, each asked once and stored, so that what reads them asks nothing.

    ``score`` is a Service, or maps a prompt Column to a Column of text or of a struct of ``names``;
    without one the error tells so.
    """
    if isinstance(score, Service):
        told = score.answers(prompts, by).withColumnRenamed("answer", names[0]).drop("attempts")
        return cut(told)
    value = score(F.col(by)) if score else F.struct(F.lit(None).cast("string").alias(names[0]), F.lit(NOT_CONFIGURED).alias(names[1]))
    told = prompts.withColumn("_told", value)
    if not isinstance(told.schema["_told"].dataType, T.StructType):
        told = told.withColumn("_told", F.struct(F.col("_told").cast("string").alias(names[0]), F.lit(None).cast("string").alias(names[1])))
    return cut(told.select("*", *[F.col(f"_told.{n}").alias(n) for n in names]).drop("_told"))


def zero_items(section: Column) -> Column:
    """All points of a section at 0, as its items."""
    item = lambda x: F.struct(values.point_number(F.lit(x)).alias("point_number"), F.lit(0.0).alias("score"))
    return F.create_map(*[c for name, items in CHECKLIST.items() for c in (F.lit(name), F.array(*map(item, items)))])[section]


def evaluate(references: DataFrame, models: DataFrame, score=None, key: str = "model_id", files: DataFrame | None = None) -> DataFrame:
    """(key, success, error, total_score, section_scores, scores_by_point) of each model of either table.

    ``score``: see stored_answers; its answers are RESPONSE_SCHEMA as JSON text. Without one, and where
    an error is stated, the model's evaluation is no success, has the first error in checklist order and
    no scores. Sections in the order of the checklist; a section without any item has its points at 0;
    of a point that comes twice the last one counts in the total, both in the section.
    """
    prompts = build_prompts(references, key, files if files is not None else models.select(key).distinct().withColumn("files", F.array().cast("array<string>")))
    answers = stored_answers(prompts, score)
    read = F.transform(values.parse_scorer_output(F.col("answer")), lambda e: F.struct(e["point_number"].alias("point_number"), values.score_or_zero(e["score"].cast("string")).alias("score")))
    items = answers.select(key, "section_ord", "section", "error", read.alias("items")).withColumn("items", F.when(F.size("items") > 0, F.col("items")).otherwise(zero_items(F.col("section"))))
    told = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_ord", "section", "error", "items"))).alias("s"))
    add = lambda xs: F.round(F.aggregate(xs, F.lit(0.0), lambda n, x: n + x), 3)
    every = F.flatten(F.col("s.items"))
    points = F.transform(F.array_sort(F.array_distinct(every["point_number"])), lambda p: F.struct(p.alias("point"), F.element_at(F.filter(F.col("every"), lambda x: x["point_number"].eqNullSafe(p)), -1)["score"].alias("score")))
    scored = told.withColumn("error", F.get(F.filter(F.col("s.error"), lambda e: e.isNotNull()), F.lit(0))).withColumn("every", every).withColumn("points", points)
    ok = F.col("error").isNull()
    return scored.select(
        key,
        ok.alias("success"),
        "error",
        F.when(ok, add(F.col("points.score"))).alias("total_score"),
        F.when(ok, F.map_from_entries(F.transform("s", lambda x: F.struct(x["section"], add(x["items"]["score"]))))).alias("section_scores"),
        F.when(ok, F.map_from_entries(F.filter("points", lambda x: x["point"].isNotNull()))).alias("scores_by_point"),
    )


def last_scores(items: DataFrame, key: str = "model_id") -> DataFrame:
    """A4: (key, point_number, score), of a point that comes twice the last one, in checklist order."""
    order = checklist_table(items.sparkSession).select("section", "section_ord").distinct()
    return items.join(F.broadcast(order), "section").groupBy(key, "point_number").agg(F.max_by("score", F.struct("section_ord", "ord")).alias("score"))


def section_scores(items: DataFrame, key: str = "model_id") -> DataFrame:
    """A3: (key, section, score), points that come twice summed twice."""
    return items.groupBy(key, "section").agg(F.round(F.sum("score"), 3).alias("score"))


def total_scores(items: DataFrame, key: str = "model_id") -> DataFrame:
    """A4: (key, total_score) of last_scores."""
    return last_scores(items, key).groupBy(key).agg(F.round(F.sum("score"), 3).alias("total_score"))
