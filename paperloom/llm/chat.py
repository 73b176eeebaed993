"""Chat formatting with typed content parts (operator 7, native).

A turn's content is an array of parts of type text, image, audio or document. A visitor, one fold
over the parts, flattens them into the turn's body: escaped text and ordered placeholders, with the
attachments' references, their expanded token counts and the places of text noted on the way.
Placeholders count through a conversation. Offsets and counters are running sums over its turns, on
the same partitioning by conversation that then gathers the turns: one shuffle in all.

Escapes: & becomes &amp; and < becomes &lt; so that no text holds a control string; in roles a line
break becomes &#10; too. Undone in the reverse order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = r"<\|(?:image|audio|document):\d+\|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:int,kind:string,ref:string,n_tokens:long>"
SPAN = "struct<start:long,length:long>"
#: Expanded tokens: an image has one for each patch of so many pixels a side, audio so many a second, a document so many a page.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 256


def text_parts(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(f"array<{PART}>")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; missing or negative measures count as one patch, no sound, one page."""
    sides = [F.ceil(F.greatest(F.coalesce(part[s], F.lit(1)), F.lit(1)) / PATCH) for s in ("width", "height")]
    return (
        F.when(part["type"] == "image", sides[0] * sides[1])
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_TOKENS))
        .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .cast("long")
    )


def is_attachment(part: Column) -> Column:
    return part["type"].isin("image", "audio", "document")


def visit(parts: Column, first: Column) -> Column:
    """Fold over a turn's parts: (body, spans of text in the body, attachments). ``first``: number of its first attachment.

    Parts of no known type are read as text; a null part or null text is empty.
    """
    empty = F.struct(F.lit("").alias("body"), F.array().cast(f"array<{SPAN}>").alias("spans"), F.array().cast(f"array<{ATTACHMENT}>").alias("attachments"))

    def step(held: Column, part: Column) -> Column:
        kind = part["type"]
        number = (first + F.size(held["attachments"])).cast("int")
        shown = escape(F.coalesce(part["text"], F.lit("")))
        mark = F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))
        attached = F.coalesce(is_attachment(part), F.lit(False))
        span = F.struct(F.length(held["body"]).cast("long").alias("start"), F.length(shown).cast("long").alias("length"))
        entry = F.struct(number.alias("number"), kind.alias("kind"), part["ref"].alias("ref"), part_tokens(part).alias("n_tokens"))
        return F.struct(
            F.concat(held["body"], F.when(attached, mark).otherwise(shown)).alias("body"),
            F.when(attached, held["spans"]).otherwise(F.concat(held["spans"], F.array(span))).alias("spans"),
            F.when(attached, F.concat(held["attachments"], F.array(entry))).otherwise(held["attachments"]).alias("attachments"),
        )

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), empty, step)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, n_turns, formatted, loss_spans, attachments, n_attachment_tokens.

    loss_spans are (start, length) in code points of ``formatted`` of the text of ``trained_role``,
    one span a text part. Turns stand in the order of ``turn_col``, nulls first, ties by role and
    then content; repeated rows are turns of their own. A null role is empty. A null conversation
    is one conversation. An empty table gives no rows; other columns are ignored. A conversation
    becomes one string, so its turns meet in one task.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(content_col).cast(f"array<{PART}>").alias("parts"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n_attached = F.size(F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(is_attachment(p), F.lit(False))))
    rows = rows.withColumns({"n_attached": n_attached, "pos": F.row_number().over(order)})
    rows = rows.withColumn("seen", visit(F.col("parts"), F.coalesce(F.sum("n_attached").over(before), F.lit(0)))).drop("parts")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = rows.withColumn("head_chars", F.length(head)).withColumn("line", F.concat(head, F.col("seen.body"), F.lit(f"{END}\n")))
    behind = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.length("line")).over(behind), F.lit(0)) + F.col("head_chars"))
    spans = F.when(F.col("role") == trained_role, F.transform("seen.spans", lambda s: F.struct((s["start"] + F.col("offset")).cast("long").alias("start"), s["length"].alias("length")))).otherwise(F.array().cast(f"array<{SPAN}>"))
    got = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "line", spans.alias("spans"), F.col("seen.attachments").alias("attachments")))).alias("t"))
    return got.select(
        F.col("conv").alias(conv_col),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join("t.line", "").alias("formatted"),
        F.flatten("t.spans").alias("loss_spans"),
        F.flatten("t.attachments").alias("attachments"),
        F.aggregate(F.flatten("t.attachments"), F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("n_attachment_tokens"),
    )


def parse_formatted(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), placeholders left out of the text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.substring(x, len(START) + 1, 2147483647))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.lit(2147483647))
        return F.struct(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(F.regexp_replace(body, PLACEHOLDER, "")).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the spans, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
