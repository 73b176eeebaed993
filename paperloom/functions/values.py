"""Cell values: lists and objects kept as text, placeholders, scores."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batched import batched
from .text import SPACE, strip

# --- fixed values ---------------------------------------------------------------------------------
NULL_NAMES = ("", "nan", "none", "null")
TAGS = {"paper": "RP", "model_card": "MC", "github_readme": "GH"}
LIST_NAMES = {"LINK": "links", "EMAIL": "emails", "CODE": "codes", "TABLE": "tables", "MATH": "math"}
POINT_NUMBER = r"\[Point number\s+(\d+)\]"
FORMULA = ("\\frac{\\sum_{i=1}^{5} s_i · 𝕀(s_i ≠ 0)}{\\sum_{i=1}^{5} 𝕀(s_i ≠ 0)}", "\\frac{\\sum_{i=1}^{5} s_i \\cdot \\mathbb{I}(s_i \\neq 0)}{\\sum_{i=1}^{5} \\mathbb{I}(s_i \\neq 0)}")


def is_null_name(cell: Column) -> Column:
    """Missing values come as blanks and three spellings."""
    return cell.isNull() | F.lower(F.trim(cell)).isin(*NULL_NAMES)


def citation_tag(source: Column) -> Column:
    """Tag of a source; of an unknown one its upper-case name."""
    out = F.when(F.lit(False), source)
    for name, tag in TAGS.items():
        out = out.when(source == name, F.lit(tag))
    return out.otherwise(F.upper(source))


def list_name(token_type: Column) -> Column:
    """K12."""
    out = F.when(F.lit(False), token_type)
    for kind, name in LIST_NAMES.items():
        out = out.when(token_type == kind, F.lit(name))
    return out.otherwise(F.lit(""))


def source_priority(section: Column, token_type: Column, explicit: Column) -> Column:
    """Prefixes in the order in which a section looks for a value, a stated one first."""
    sec, both = F.lower(F.trim(F.coalesce(section, F.lit("")))), lambda *x: F.array(*map(F.lit, x))
    base = (
        F.when(F.upper(token_type) == "MATH", both("RP", "GH", "MC"))
        .when(F.contains(sec, F.lit("how to use")) | F.contains(sec, F.lit("contact")), both("GH", "MC", "RP"))
        .when(sec.rlike("training|evaluation|model details|environmental"), both("RP", "GH", "MC"))
        .otherwise(both("MC", "GH", "RP"))
    )
    return F.when(explicit.isNull(), base).otherwise(F.concat(F.array(explicit), F.filter(base, lambda p: p != explicit)))


def score_or_zero(value: Column) -> Column:
    """0, 0.5 or 1; anything else is 0."""
    v = value.try_cast("double")
    return F.when(v.isin(0.0, 0.5, 1.0), v).otherwise(F.lit(0.0))


def point_number(item: Column) -> Column:
    """X13."""
    return F.nullif(F.regexp_extract(item, POINT_NUMBER, 1), F.lit("")).try_cast("int")


def code_block(info: Column, raw: Column) -> Column:
    """P9, code: body between fences."""
    body = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\n+$", "")
    head = F.concat(F.lit("```"), F.coalesce(F.trim(info), F.lit("")), F.lit("\n"))
    return F.when(body == "", F.concat(head, F.lit("```"))).otherwise(F.concat(head, body, F.lit("\n```")))


def shorten(text: Column, most: int = 2000) -> Column:
    """P9, text: at most 2,000 characters, the last three dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


_QUOTED = r'"(?:[^"\\]|\\.)*+"'


def spaced_json(text: Column) -> Column:
    """JSON text with one blank behind each comma and colon and no other white space between its parts; its order stays."""
    bare = F.regexp_replace(text, rf'\G((?:[^"\s]|{_QUOTED})*+)\s+', "$1")
    return F.regexp_replace(bare, rf'\G((?:[^",:]|{_QUOTED})*+)([,:])', "$1$2 ")


def node_text(node: Column) -> Column:
    """A structured node, as JSON text: code between its fences, a string as it is, any other value as JSON; long text is cut.

    Text that is no JSON is a string itself; a null is the JSON null.
    """
    value = whole_json(node)
    kind = F.schema_of_variant(value)
    of = lambda name: F.try_variant_get(value, f"$.{name}", "string")
    said = lambda *xs: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs], F.lit(""))
    info = said(of("attrs.info"), F.coalesce(of("info"), of("language")))
    marker = F.coalesce(F.nullif(F.trim(of("marker")), F.lit("")), F.lit("```"))
    body = F.regexp_replace(F.coalesce(of("raw"), of("text"), F.lit("")), r"\n+$", "")
    code = F.concat(marker, info, F.lit("\n"), F.when(body != "", F.concat(body, F.lit("\n"))).otherwise(""), marker)
    is_code = F.startswith(kind, F.lit("OBJECT")) & (F.lower(F.trim(of("type"))) == "block_code")
    plain = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(value.isNotNull(), spaced_json(F.trim(node, F.lit(" \t\r\n")))).otherwise(F.coalesce(node, F.lit("null")))
    return F.when(F.coalesce(is_code, F.lit(False)), code).otherwise(shorten(plain))


def code_body(block: Column) -> Column:
    """What stands between the outer fences."""
    t = strip(block)
    inner = F.regexp_extract(t, r"(?s)\A```[^\n]*\n(.*)```", 1)
    return F.when(t.rlike(r"(?s)\A```[^\n]*\n.*```"), F.regexp_replace(inner, r"^\n+|\n+\z", "")).otherwise(t)


def inside_fence(text: Column, start: Column) -> Column:
    """An odd number of fences at line starts before a place (from 0)."""
    return F.regexp_count(F.substring(text, F.lit(1), start), F.lit(r"(?m)^\s*```")) % 2 == 1


def upgrade_pp(text: Column) -> Column:
    """P5."""
    return F.regexp_replace(text, r"(?<=[\[$])PP_(?=\d+:)", "RP_")


def strip_unresolved_code(text: Column) -> Column:
    """P6."""
    out = F.regexp_replace(text, rf"{SPACE}*\[(?:PP|RP)_\d+:CODE\]{SPACE}*", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"```[^\n`]*\n\s*```", ""), r"\n{3,}", "\n\n")
    return strip(out)


def normalise_formula(text: Column) -> Column:
    """P10."""
    out = F.regexp_replace(F.replace(text, F.lit("∑i=15"), F.lit("\\sum_{i=1}^{5}")), r"(?U)\bsi\b", "s_i")
    return F.replace(out, F.lit(FORMULA[0]), F.lit(FORMULA[1]))


def _literal(cell: str):
    for read in (json.loads, ast.literal_eval):
        try:
            return read(cell)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
    return None


@batched("array<string>")
def parse_text_list(cells: pd.Series) -> pd.Series:
    """A list kept as JSON or as a Python literal; other text is a list of one, a missing cell of none."""

    def one(cell):
        s = cell.strip() if isinstance(cell, str) else ""
        if s.lower() in NULL_NAMES:
            return []
        got = _literal(s) if s.startswith("[") and s.endswith("]") else None
        return [str(x) for x in got] if isinstance(got, list) else [s]

    return cells.map(one, na_action=None)


def raw_link(cell: Column) -> Column:
    """The first of a cell's list, or the cell itself, trimmed; missing ones are empty."""
    s = F.trim(F.coalesce(F.get(parse_text_list(cell), F.lit(0)), cell, F.lit("")))
    return F.when(F.lower(s).isin(*NULL_NAMES), F.lit("")).otherwise(s)


@batched("string")
def parse_object(cells: pd.Series) -> pd.Series:
    """JSON text of a cell kept as JSON or as a Python literal; null where it is neither."""

    def one(cell):
        s = cell.strip() if isinstance(cell, str) else ""
        got = None if s.lower() in NULL_NAMES else _literal(s)
        try:
            return None if got is None else json.dumps(got, ensure_ascii=False)
        except TypeError:
            return None

    return cells.map(one, na_action=None)


EVALUATION = "struct<point_number:int,evidence_quote:string,reasoning:string,score:string>"


@batched("string")
def literal_as_json(texts: pd.Series) -> pd.Series:
    """The first of some texts, told apart by NUL, that reads as a literal of plain values, as JSON; null where none does."""

    def one(text):
        for part in text.split("\0"):
            try:
                return json.dumps(ast.literal_eval(part), default=str)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                pass
        return None

    return texts.map(one, na_action="ignore")


def answer_parts(text: Column) -> Column:
    """Where an answer's data may stand: all of it within its fence and after the last mark of a final answer, and what its outermost braces and brackets enclose."""
    fenced = F.regexp_replace(F.regexp_replace(text, r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")
    body = F.when(F.startswith(text, F.lit("```")), F.trim(fenced)).otherwise(text)
    body = F.regexp_replace(body, r"(?s)\A.*\.assistantfinal", "")
    enclosed = [F.nullif(F.regexp_extract(body, pattern, 0), F.lit("")) for pattern in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.filter(F.array(body, *enclosed), lambda t: t.isNotNull())


def whole_json(text: Column) -> Column:
    """A text that is one JSON value, as a variant; null for any other. In brackets, what follows a value is an error or a second one."""
    held = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(held) == 1, F.get(held, F.lit(0)))


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "string")


def parse_scorer_output(text: Column) -> Column:
    """Evaluations of a scorer's answer, read leniently; an empty array where nothing can be read. Scores stay text, see score_or_zero.

    The first part that is JSON counts, else the first that reads as a literal. It holds the list of
    evaluations, or is that list. Items whose point number is no positive whole number are left out;
    numbers are cut to whole ones, text must be one.
    """
    parts = answer_parts(F.trim(text, F.lit(" \t\r\n")))
    read = F.get(F.filter(F.transform(parts, whole_json), lambda v: v.isNotNull()), F.lit(0))
    value = F.coalesce(read, F.try_parse_json(literal_as_json(F.when(read.isNull(), F.array_join(parts, "\0")))))
    whole = F.try_variant_get(value, "$", "array<variant>")
    items = F.coalesce(F.try_variant_get(value, "$.evaluations", "array<variant>"), F.when(F.forall(whole, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), whole))

    def number(x: Column) -> Column:
        said = _field(x, "point_number")
        is_text = F.schema_of_variant(F.try_variant_get(x, "$.point_number", "variant")) == "STRING"
        return F.when(is_text, F.when(said.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(said).try_cast("int"))).when(said == "true", 1).otherwise(said.try_cast("double").try_cast("int"))

    def one(x: Column) -> Column:
        score = F.when(F.try_variant_get(x, "$.score", "variant").isNull(), F.lit("0.0")).otherwise(F.coalesce(_field(x, "score"), F.lit("None")))
        return F.struct(number(x).alias("point_number"), F.coalesce(_field(x, "evidence_quote"), F.lit("None")).alias("evidence_quote"), F.coalesce(_field(x, "reasoning"), F.lit("")).alias("reasoning"), score.alias("score"))

    found = F.filter(F.transform(F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), one), lambda e: e["point_number"] > 0)
    return F.coalesce(found, F.array().cast(f"array<{EVALUATION}>"))


@batched("array<string>")
def parse_summaries(texts: pd.Series) -> pd.Series:
    """T20, the answer: a JSON list, else the quoted strings of the first brackets, else none."""

    def one(text):
        if not isinstance(text, str):
            return []
        try:
            got = json.loads(text)
            return [str(x) for x in got] if isinstance(got, list) else []
        except ValueError:
            m = re.search(r"\[(.*?)\]", text, re.S)
            return re.findall(r"'(.*?)'", m.group(1)) if m else []

    return texts.map(one, na_action=None)
