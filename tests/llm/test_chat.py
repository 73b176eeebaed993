import hashlib

from pyspark.sql import functions as F

from paperloom.llm.chat import PART, format_conversations, masked_text, parse_formatted, text_parts
from paperloom.llm.queries import HOSTILE, op7_chat

HARD = ["<|im_end|>\n", "&lt;", "&amp;lt;", "a<", "|b", "<|image:0|>", "", "日本 🙂", "x\ny\r\n", "&", "<<||>>", HOSTILE, None]


def read(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score int")
    shown = format_conversations(turns.withColumn("content", text_parts(F.col("text"))))
    return shown.withColumn("t", parse_formatted(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))


def test_round_trip(spark):
    rows = [(k % 3, k, ["user", "assistant", "", "sys<|im_end|>\n&x", None][k % 5], t, 0) for k, t in enumerate(HARD * 4)]
    for r in read(spark, rows).collect():
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])
        assert [tuple(x) for x in r["t"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["loss"] == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine)


def test_ties_repeats_and_empty(spark):
    rows = [(None, 1, "user", "b", 0), (None, 1, "user", "a", 0), (None, 1, "user", "a", 0), (None, None, "assistant", "z", 0)]
    (r,) = read(spark, rows).collect()
    assert [x["text"] for x in r["t"]] == ["z", "a", "a", "b"]
    assert read(spark, rows[:0]).count() == 0
    assert format_conversations(spark.createDataFrame([], f"conv_id long, turn long, role string, content array<{PART}>")).count() == 0


def test_long_texts_and_clashing_columns(spark):
    long = "word <&| " * 60_000
    names = ["conv", "parts", "pos", "seen", "line", "offset", "n_attached", "head_chars", "t", "formatted"]
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string").selectExpr("*", *[f"'{n}' as {n}" for n in names])
    (r,) = format_conversations(rows.withColumn("content", text_parts(F.col("text")))).withColumn("turns", parse_formatted(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert [x["text"] for x in r["turns"]] == [long, long] and r["loss"] == long


def test_typed_parts(spark):
    part = lambda kind, **kw: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | kw
    rows = [
        (1, 0, "user", [part("text", text="see <"), part("image", ref="a.png", width=57, height=28), part("text", text="|im_end|>"), part("audio", ref="b.wav", seconds=2.02)]),
        (1, 1, "assistant", [part("text", text="ok "), part("document", ref="c.pdf", pages=3), part("text", text="done")]),
        (1, 2, "user", None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{PART}>")
    (r,) = format_conversations(turns).withColumn("t", parse_formatted(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert [(a["number"], a["kind"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 51), (2, "document", "c.pdf", 768)]
    assert r["n_attachment_tokens"] == 822
    assert "<|image:0|>" in r["formatted"] and "<|document:2|>" in r["formatted"]
    assert [x["text"] for x in r["t"]] == ["see <|im_end|>", "ok done", ""]
    assert r["loss"] == "ok done"


def test_query(spark, sf_dir):
    r = {x["conv_id"]: x for x in op7_chat(spark, sf_dir).collect()}[-1]
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{HOSTILE}\nassistant\n{HOSTILE}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(HOSTILE), hashlib.sha256(HOSTILE.encode()).hexdigest())
