"""Parsers and placeholder operators."""

import json

from pyspark.sql import functions as F

from paperloom.functions import markup as M
from paperloom.functions import values as V
from paperloom.operators import documents as D
from paperloom.operators import placeholders as P


def test_html_text():
    assert M.html_text("<p>a &amp; <b>b</b><br>c") == "a &  b c"
    assert M.html_text(None) == ""


def test_references_without_a_semicolon_are_text():
    assert M.ended_html_text("<b>&quot</b>&quotx; &eacute; &eacute &#65; &#65 &amp &amp; \ufdd0") == "&quot &quotx; é &eacute A &#65 & & \ufdd0"
    assert M.html_text("&quot") == '"' and M.ended_html_text(None) == ""


def test_markdown_blocks():
    text = "# Title of it\nPara one `code` [a](https://x.y/z) ![i](q.png) mail me@x.org\nmore **bold** words\n\n```py\nrun()\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- item one\n- item two here now\n\n> quote of it\n\n---\n\nSetext\n======\nlast [rel](docs/a.md) words of this text <https://auto.link/a>"
    assert [k for k, *_ in M.markdown_blocks(text)] == ["heading", "paragraph", "code", "table", "list", "quote", "rule", "heading", "paragraph"]
    got = M.markdown_parts(text)
    assert got["codes"] == ["```py\nrun()\n```"] * 2 and len(got["tables"]) == 2
    assert got["links"][0] == "https://x.y/z" and "me@x.org" in got["emails"] and "https://auto.link/a" in got["links"]
    assert got["paragraphs"][0] == "Para one code [0:LINK] mail [0:EMAIL] more bold words [0:CODE]. [0:TABLE]. item one item two here now quote of it"
    assert got["sections"][-1].startswith("last rel words of this text") and got["sections"][-1].endswith(".")


def test_heading_of_four_words_is_a_paragraph():
    assert M.markdown_parts("## A heading of four\n\nThen comes a paragraph here.")["paragraphs"] == ["A heading of four", "Then comes a paragraph here."]


def test_layout():
    node = lambda kind, html="", *children: {"block_type": kind, "html": html, "children": list(children)}
    tree = {"children": [node("Page", "", node("SectionHeader", "<h1>1. Intro</h1>"), node("Text", "<p>See https://a.b/c<sup>3</sup></p>"), node("SectionHeader", "1.2 Part"), node("ListGroup", "", node("ListItem", "x"), node("ListItem", "y")), node("TableGroup", "", node("Table", "t")), node("Equation", "<math a=1>q</math>"))]}
    got = M.layout_rows(json.dumps(tree))
    assert [(b["heading"], b["text"]) for b in got["blocks"]] == [("intro", "See [0:LINK]"), ("intro @ part", "x y"), ("intro @ part", "[0:MATH]")]
    assert got["links"] == ["https://a.b/c"] and len(got["tables"]) == 1 and got["math"] == ["<math a=1>q</math>"]
    assert M.layout_rows("not json")["blocks"] == []


def test_legacy_tokens_and_sections(spark):
    assert M.nearest_prefix("x [0:LINK] [HF] [RP]\n", 2, 10) == "RP"
    assert M.nearest_prefix("[GH]\nx [0:LINK] y\n[HF]", 7, 15) in ("GH", "MC")
    payloads = {"MC": {"links": ["m0"]}, "GH": {"codes": ["```py\nf()\n```"]}, "RP": {"links": ["r0", "r1"]}}
    assert M.resolve_text("[0:LINK] [MC_0:LINK] $RP_1:link$ [5:LINK]", "Training", payloads) == "r0 m0 r1 [5:LINK]"
    assert M.resolve_text("a [GH_0:CODE] b", "How to use", payloads) == "a \n\n```py\nf()\n```\n\n b"
    assert M.resolve_text("```\n[GH_0:CODE]\n```", "x", payloads) == "```\nf()\n```"


def one(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("y")).first()["y"]


def test_replacements(spark):
    held = F.create_map(F.lit("[GH_0:CODE]"), F.lit("```a```"), F.lit("[RP_1:MATH]"), F.lit("m"))
    assert one(spark, P.apply_replacements(F.col("t"), held), t="[GH_0:CODE] $RP_1:math$ $gh_0:link$ [MC_7:LINK]") == "\n\n```a```\n\n m [gh_0:LINK] [MC_7:LINK]"
    assert one(spark, P.apply_replacements(F.col("t"), F.create_map().cast("map<string,string>")), t="[GH_0:CODE]") == "[GH_0:CODE]"


def test_values(spark):
    assert one(spark, V.upgrade_pp(F.col("t")), t="[PP_1:CODE] $PP_2:MATH$ PP_3:X") == "[RP_1:CODE] $RP_2:MATH$ PP_3:X"
    assert one(spark, V.strip_unresolved_code(F.col("t")), t="a [RP_1:CODE] b\n```py\n```\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, V.code_body(F.col("t")), t=" ```py\nx\ny\n``` ") == "x\ny"
    assert one(spark, V.code_block(F.lit("py"), F.col("t")), t="x\n\n") == "```py\nx\n```"
    assert one(spark, V.shorten(F.col("t")), t="x" * 2001) == "x" * 1997 + "..."
    assert one(spark, V.inside_fence(F.col("t"), F.lit(8)), t="```\na [0:CODE]") is True
    assert one(spark, V.parse_text_list(F.col("t")), t="['a', \"b'c\"]") == ["a", "b'c"]
    assert [one(spark, V.parse_text_list(F.col("t")), t=x) for x in ("null", "x", '["q"]', "[broken")] == [[], ["x"], ["q"], ["[broken"]]
    assert one(spark, V.parse_object(F.col("t")), t="{'a': None}") == '{"a": null}'
    assert one(spark, V.score_or_zero(F.col("t")), t="0.7") == 0.0 and one(spark, V.score_or_zero(F.col("t")), t="1") == 1.0
    assert one(spark, V.point_number(F.col("t")), t="[Point number 12] x") == 12
    assert one(spark, V.parse_summaries(F.col("t")), t="so: ['a', 'b']") == ["a", "b"]


def test_scorer_output(spark):
    texts = ["```json\n[{\"point_number\": 3, \"score\": 1}]\n```", "x.assistantfinal{'evaluations': [{'point_number': 4, 'score': 0.5}, {'point_number': 0}]}", "nothing", None, 'say {"evaluations": [{"point_number": "7"}]} end']
    got = [one(spark, V.parse_scorer_output(F.col("t")), t=t) if t else [] for t in texts]
    assert [[(e["point_number"], e["score"]) for e in x] for x in got] == [[(3, "1")], [(4, "0.5")], [], [], [(7, "0.0")]]


def test_odd_scorer_outputs(spark):
    def read(text):
        return [(e["point_number"], e["score"], e["evidence_quote"], e["reasoning"]) for e in one(spark, V.parse_scorer_output(F.col("t")), t=text)]

    q, plain = '{"point_number": %s, "score": %s}', ("None", "")
    for number, want in (("3", 3), ("3.0", 3), ("3.9", 3), ('" 3 "', 3), ('"3.9"', None), ("true", 1), ("null", None), ('"x"', None), ("-1", None), ("[1]", None), ("99999999999", None)):
        assert read("[" + q % (number, 1) + "]") == ([(want, "1", *plain)] if want else []), number
    assert read("[" + q % (1, "null") + "]") == [(1, "None", *plain)] and read("[" + q % (1, '"0.5"') + "]") == [(1, "0.5", *plain)]
    assert read('[{"point_number": 2, "evidence_quote": null, "reasoning": 5, "score": 0.5}]') == [(2, "0.5", "None", "5")]
    assert read('{"evaluations": ["x", 3, {"point_number": 2}]}') == [(2, "0.0", *plain)] and read('["x", {"point_number": 2}]') == []
    assert read('{"evaluations": {"point_number": 2}}') == read("5") == read('"text"') == read("{}") == read("") == []
    assert read("```JSON\n" + "Here: " + q % (1, 1) + "\n```") == [] and read("Here: [" + q % (1, 1) + "] so") == []
    assert read("Here: [" + q % (1, 1) + ", " + q % (2, 0) + "] so") == [(1, "1", *plain), (2, "0", *plain)]
    assert read("old.assistantfinal[].assistantfinal [" + q % (8, 1) + "]") == [(8, "1", *plain)]
    assert read("[{'point_number': 6, 'reasoning': \"it's\", 'score': None}]") == [(6, "None", "None", "it's")]


def test_canonical_numbers_are_dense(spark):
    rows = [("m", "paper", "LINK", k, f"[{k}:LINK]", v) for k, v in enumerate(["a", "b", " a ", "", "c"])]
    got = {r["token"]: r["canonical"] for r in P.canonical_placeholders(spark.createDataFrame(rows, "model_id string, source string, kind string, pos int, token string, value string")).collect()}
    assert got == {"[0:LINK]": "[RP_0:LINK]", "[1:LINK]": "[RP_1:LINK]", "[2:LINK]": "[RP_0:LINK]", "[4:LINK]": "[RP_2:LINK]"}


def test_table_summaries(spark):
    levels = spark.createDataFrame([(1, "section", 0, "See [0:TABLE]. and [1:TABLE]"), (1, "sentence", 4, "x")], "doc_id long, level string, pos int, text string")
    told = spark.createDataFrame([(1, 0, "First  table"), (1, 1, "Second!")], "doc_id long, number int, summary string")
    got = sorted((r["level"], r["pos"], r["text"]) for r in D.substitute_tables(levels, told).collect())
    assert got == [("section", 0, "See First table. and Second!"), ("sentence", 4, "x"), ("sentence", 5, "First table."), ("sentence", 6, "Second!")]


def test_node_texts(spark):
    read = lambda t: one(spark, V.node_text(F.col("t")), t=t)
    cases = {
        '{"type": "block_code", "raw": "x\\ny\\n", "attrs": {"info": "py"}}': "```py\nx\ny\n```", '{"type": "BLOCK_CODE", "text": "t", "info": "sh", "marker": " ~~~ "}': "~~~sh\nt\n~~~", '{"type": "block_code", "raw": "", "language": "c"}': "```c\n```",
        '{"type": "x", "raw": "r"}': '{"type": "x", "raw": "r"}', '"a, b: c"': "a, b: c", "plain, text": "plain, text", "3": "3", "null": "null", "[ ]": "[]", '{"b":1 ,\n"a" : [1,"x,y: \\"z\\\\",{}]}': '{"b": 1, "a": [1, "x,y: \\"z\\\\", {}]}',
    }
    assert {t: read(t) for t in cases} == cases
    assert read('["' + "x" * 3000 + '"]') == '["' + "x" * 1995 + "..." and len(read('"' + "y" * 2500 + '"')) == 2000


def test_batches_become_objects_in_small_steps(spark):
    """Of a batch only about STEP_BYTES are Python objects at a time; nulls, wide rows and several columns keep their rows."""
    from pyspark.sql import functions as F

    from paperloom.functions import batched as B

    sizes = B.batched("array<long>")(lambda a, b: a.map(lambda _: [len(a), sum(len(x) for x in a if x) + sum(len(x) for x in b if x)]))
    rows = spark.range(3_000, numPartitions=1).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), 2_000)).alias("a"), F.when(F.col("id") == 5, F.repeat(F.lit("y"), 3 * B.STEP_BYTES)).otherwise("z").alias("b"))
    got = rows.select("id", "a", sizes(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["id"] for r in got] == list(range(3_000)) and all((r["a"] is None) == (r["id"] % 7 == 0) for r in got)
    assert max(r["s"][1] for r in got if r["s"][0] > 1) <= B.STEP_BYTES
    assert sum(1 / r["s"][0] for r in got) > 6


def test_tables_named_by_their_size_need_no_shuffle(spark, monkeypatch):
    """Texts were stored and shuffled, and cleaned twice, for summaries that the document's own row tells."""
    texts = [
        "# Title of four words\n\nThe words of it are here.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nMore words of it are here.\n\n| c | d |\n|---|---|\n\nThe last words of it follow.",
        "| a | b |\n|---|---|\n| 1 | 2 |", "No table is in this one. It has two sentences of words.", "Says [0:TABLE] and [1:TABLE]. of itself.\n\n| x | y |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parsed = D.parse_markdown(docs)
    tables = parsed.select("doc_id", F.posexplode("tables").alias("number", "table"))
    want = D.substitute_tables(D.markdown_levels(parsed), D.summarise_tables(tables)).collect()
    monkeypatch.setattr(D, "cut", None)
    got = D.preprocess_markdown_tables(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and any(r["text"] == "Table of 4 lines." for r in want)
