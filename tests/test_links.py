"""Link functions and ranking on literal rows."""

from pyspark.sql import functions as F

from paperloom.functions import links as L
from paperloom.functions import markup
from paperloom.operators import ranking as R


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("y")).first()["y"]


def test_arxiv_ids_by_pattern_then_place(spark):
    assert one(spark, L.arxiv_ids, "https://hf.co/papers/2301.00001 https://arxiv.org/pdf/1706.03762v5 http://arxiv.org/abs/2005.1") == ["1706.03762", "2005.1", "2301.00001"]


def test_github_links(spark):
    text = "https://github.com/o/r/blob/main/x.json https://github.com/o/r/blob/main/run.py. git://github.com/org https://github.com/o/issues-x https://github.com/o/r/tree/main/sub https://github.com/org/ https://github.com/O/R/issues/5 (https://github.com/a/b)"
    assert one(spark, L.github_links, text) == ["https://github.com/o/r", "git://github.com/org", "https://github.com/o/r/tree/main/sub", "https://github.com/O/R", "https://github.com/a/b"]


def test_tokens(spark):
    assert one(spark, L.tokens, "org/e5-base_v2.0") == ["org", "e5", "base", "v2", "0"]
    assert one(spark, L.tokens, "a//b/") == ["a", "", "b", ""]
    assert one(spark, L.tokens, "llama-3-7b") == ["llama", "3", "7b"]


def test_labels(spark):
    text = "- **Paper**: https://arxiv.org/abs/1234.56789 and https://aclanthology.org/P1/\nOriginal paper: https://arxiv.org/abs/9999.99999\nCode: https://github.com/O/R\nsee https://github.com/x/y"
    assert sorted(one(spark, L.labelled_paper_refs, text)) == ["1234.56789", "https://aclanthology.org/P1"]
    assert one(spark, L.labelled_repos, text) == ["o/r"]


def test_normalise(spark):
    cases = {"http://A.b/c/?q#f": "https://a.b/c", "https://g.c/r.git": "https://g.c/r", "https://arxiv.org/pdf/1.2.pdf": "https://arxiv.org/abs/1.2", "HTTP://X": "http://x", "NaN": "", None: "", "https://a/b///": "https://a/b"}
    for url, want in cases.items():
        assert one(spark, L.normalise_link, url) == want, url


def test_github_parts(spark):
    assert tuple(one(spark, L.github_parts, "https://github.com/o/r/blob/main/docs/a.md")) == ("o", "r", "docs/a.md")
    assert tuple(one(spark, L.github_parts, "https://github.com/o/r.git")) == ("o", "r", None)
    assert tuple(one(spark, L.github_parts, "https://github.com/o")) == ("o", "", None)


def test_other_papers(spark):
    assert [tuple(x) for x in one(spark, L.other_paper_urls, "https://aclanthology.org/P1/ https://openaccess.thecvf.com/html/x.html https://other.org/a")] == [("https://aclanthology.org/P1", "https://aclanthology.org/P1.pdf"), ("https://openaccess.thecvf.com/html/x.html", "https://openaccess.thecvf.com/papers/x.pdf")]


def test_bibtex():
    text = "@article{a,\n title = {A {B} c},\n eprint={2101.00001},\n archivePrefix={arXiv},\n url = \"https://arxiv.org/abs/2101.00001\"\n}\n@misc{b,\n journal={arXiv preprint arXiv:1907.11692}\n}\n@bad{\n}"
    assert markup.bibtex_ids(text) == ["2101.00001", "2101.00001", "1907.11692"]


def cards(spark, *texts, model="org/tool-x"):
    return spark.createDataFrame([(k, model, t) for k, t in enumerate(texts)], "doc_id long, model_id string, card string")


def test_github_rank(spark):
    df = cards(spark, "https://github.com/a/b https://github.com/org/tool", "https://github.com/a/b https://github.com/c/d", "https://github.com/lab/m https://github.com/lab/m/tree/x/y https://github.com/q/r", "none")
    got = {}
    for r in R.rank_github(df).filter("is_primary").collect():
        got[r["doc_id"]] = (r["link"], r["score"])
    assert got == {0: ("https://github.com/org/tool", 6), 2: ("https://github.com/lab/m", 2)}  # of two repositories neither has more than half


def test_paper_rank(spark):
    front = "---\nx: 1\n---\n"
    df = cards(spark, front + "https://arxiv.org/abs/1111.11111 then https://arxiv.org/abs/2222.22222\nPaper: https://arxiv.org/abs/2222.22222", "https://arxiv.org/abs/3333.33333 https://arxiv.org/abs/4444.44444")
    ranked = R.rank_papers(df)
    top = {r["doc_id"]: r["candidate"] for r in ranked.filter("rank = 1").collect()}
    assert top == {0: "2222.22222", 1: "3333.33333"}


def test_selection_with_titles(spark):
    df = cards(spark, "https://arxiv.org/abs/1111.11111 https://arxiv.org/abs/2222.22222", "no paper https://github.com/a/b")
    papers = spark.createDataFrame([("1111.11111", "Other", "thing"), ("2222.22222", "Tool of ours", "code at github.com/org/tool.")], "arxiv_id string, title string, summary string")
    (r,) = R.select_links(df, papers=papers).collect()
    assert r["primary_paper"].endswith("2222.22222.pdf") and r["primary_github"] == "https://github.com/org/tool" and len(r["secondary_papers"]) == 1
