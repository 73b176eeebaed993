"""Choosing primary papers and repositories by score, with ties to the earlier candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import markup
from ..functions import text as T

# --- fixed values ----------------------------------------------------------------------------------
PAPER_FREQUENCY, PAPER_LABEL, PAPER_BIBTEX = 2, 5, 5
GITHUB_TOKEN, GITHUB_LABEL, GITHUB_FIRST, GITHUB_LEAST = 3, 5, 2, 3


def _candidates(text: Column, bibtex: Column) -> Column:
    """Array of (id, url), archive identifiers first, then other papers."""
    archive = F.transform(F.array_distinct(F.concat(L.arxiv_ids(text), bibtex)), lambda x: F.struct(x.alias("id"), L.arxiv_pdf_url(x).alias("url")))
    return F.concat(archive, L.other_paper_urls(text))


def _bibtex(text: Column, wanted: bool) -> Column:
    return markup.arxiv_ids_of_bibtex(text) if wanted else F.array().cast("array<string>")


def paper_candidates(cards: DataFrame, key: str = "doc_id", text_col: str = "card", bibtex: bool = True) -> DataFrame:
    """(key, pos, candidate, url); other papers may repeat."""
    rows = cards.select(key, F.col(text_col).alias("_t"), _bibtex(F.col(text_col), bibtex).alias("_b"))
    return rows.select(key, F.posexplode(_candidates(F.col("_t"), F.col("_b"))).alias("pos", "c")).select(key, "pos", F.col("c.id").alias("candidate"), F.col("c.url").alias("url"))


def rank_papers(cards: DataFrame, key: str = "doc_id", text_col: str = "card", bibtex: bool = True, frequency: int = PAPER_FREQUENCY, label: int = PAPER_LABEL, source: int = PAPER_BIBTEX) -> DataFrame:
    """R2: (key, candidate, url, pos, score, rank) of distinct candidates.

    Score: occurrences (one at least) times a weight, a bonus for a labelled line, one for a BibTeX
    entry, and the ordinal by place from the end, raised by how early the place is. All that needs
    the card's text is measured in the card's own row; only the measures are shuffled.
    """
    rows = cards.select(key, F.col(text_col).alias("_t"), _bibtex(F.col(text_col), bibtex).alias("_b"))
    rows = rows.select(key, "_b", T.strip_front_matter(F.col("_t")).alias("_body"), _candidates(F.col("_t"), F.col("_b")).alias("_c"))
    rows = rows.withColumn("_labels", L.labelled_paper_refs(F.col("_body"))).withColumn("_ids", F.transform("_c", lambda c: c["id"]))
    measured = F.transform(
        "_c",
        lambda c, i: F.struct(
            c["id"].alias("candidate"),
            c["url"].alias("url"),
            i.alias("pos"),
            T.count_literal(F.col("_body"), c["id"]).alias("n"),
            (F.position(c["id"], F.col("_body")) - 1).alias("at"),
            F.length("_body").alias("length"),
            F.exists("_labels", lambda x: F.contains(c["id"], x) | F.contains(x, c["id"])).alias("labelled"),
            F.array_contains("_b", c["id"]).alias("cited"),
            (F.array_position("_ids", c["id"]) == i + 1).alias("first"),
        ),
    )
    rows = rows.select(key, F.explode(F.filter(measured, lambda m: m["first"])).alias("m")).select(key, "m.*")
    placed = Window.partitionBy(key).orderBy(F.when(F.col("at") >= 0, F.col("at")).asc_nulls_last(), "pos")
    count = F.sum((F.col("at") >= 0).cast("int")).over(Window.partitionBy(key))
    ordinal = count - F.row_number().over(placed) + 1
    decay = 1.0 - F.col("at") / F.greatest("length", F.lit(1))
    score = F.greatest("n", F.lit(1)) * frequency + F.when(F.col("labelled"), label).otherwise(0) + F.when(F.col("cited"), source).otherwise(0) + F.when(F.col("at") >= 0, F.rint(ordinal * (1 + decay)).cast("int")).otherwise(0)
    rows = rows.withColumn("score", score.cast("long"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))).select(key, "candidate", "url", "pos", "score", "rank")


def match_titles(candidates: DataFrame, papers: DataFrame, key: str = "doc_id", model_col: str = "model_id") -> DataFrame:
    """Candidates whose title or abstract names the model, or its first part of three letters or more.

    ``papers``: (arxiv_id, title, summary). Adds ``matched``; a single match of a key is its primary.
    """
    told = F.lower(F.concat_ws(" ", "title", "summary"))
    name = F.element_at(F.split(F.lower(F.col(model_col)), "/"), -1)
    stem = F.substring_index(name, "-", 1)
    joined = candidates.join(papers.select(F.col("arxiv_id").alias("candidate"), told.alias("_told")), "candidate", "left")
    return joined.withColumn("matched", F.coalesce(F.contains("_told", name) | ((F.length(stem) >= 3) & F.contains("_told", stem)), F.lit(False))).drop("_told")


def github_candidates(cards: DataFrame, key: str = "doc_id", text_col: str = "card") -> DataFrame:
    """(key, pos, link), distinct, in card order."""
    return cards.select(key, F.posexplode(F.array_distinct(L.github_links(F.col(text_col)))).alias("pos", "link"))


def rank_github(cards: DataFrame, key: str = "doc_id", text_col: str = "card", model_col: str = "model_id", token: int = GITHUB_TOKEN, label: int = GITHUB_LABEL, first: int = GITHUB_FIRST, least: int = GITHUB_LEAST) -> DataFrame:
    """(key, pos, link, score, is_primary).

    Score: shared tokens of model and path, a labelled line, the first place. Below ``least``, the
    shortest link of the repository that has more than half of the links is primary, or none is.
    Only short columns are shuffled: links and labels are taken from the card in the scan's stage.
    """
    model = F.array_distinct(L.tokens(F.lower(F.col(model_col))))
    rows = cards.select(key, model.alias("_model"), L.labelled_repos(F.col(text_col)).alias("_labelled"), F.posexplode(F.array_distinct(L.github_links(F.col(text_col)))).alias("pos", "link"))
    path = L.repo_and_extra(F.col("link"))
    repo = L.repo_of(F.col("link"))
    score = F.size(F.array_intersect("_model", F.array_distinct(L.tokens(path)))) * token + F.when(F.array_contains("_labelled", repo), label).otherwise(0) + F.when(F.col("pos") == 0, first).otherwise(0)
    rows = rows.select(key, "pos", "link", repo.alias("repo"), score.cast("long").alias("score"))
    all_of, of_repo = Window.partitionBy(key), Window.partitionBy(key, "repo")
    rows = rows.withColumns({"best": F.max("score").over(all_of), "links": F.count(F.lit(1)).over(all_of), "of_repo": F.count(F.lit(1)).over(of_repo), "rank": F.row_number().over(all_of.orderBy(F.desc("score"), "pos"))})
    short = F.row_number().over(of_repo.orderBy(F.length("link"), "pos"))
    rows = rows.withColumn("short", short)
    primary = F.when(F.col("best") >= least, F.col("rank") == 1).otherwise((F.col("of_repo") > F.col("links") / 2) & (F.col("short") == 1) & F.col("repo").isNotNull())
    return rows.select(key, "pos", "link", "score", F.coalesce(primary, F.lit(False)).alias("is_primary"))


def select_links(cards: DataFrame, key: str = "doc_id", text_col: str = "card", model_col: str = "model_id", papers: DataFrame | None = None, bibtex: bool = True, with_repository: bool = False) -> DataFrame:
    """(key, primary_paper, secondary_papers, primary_github, secondary_github).

    Cards without a paper are left out (F10), and ``with_repository``, as a batch has it, those without
    a primary repository too (F11). ``papers`` holds titles and abstracts; without it
    papers are chosen by rank alone and no repository is looked for in an abstract.
    """
    ranked = rank_papers(cards, key, text_col, bibtex)
    if papers is not None:
        named = match_titles(ranked.join(cards.select(key, model_col), key), papers, key, model_col)
        hits = F.sum(F.col("matched").cast("int")).over(Window.partitionBy(key))
        ranked = named.withColumn("rank", F.when(hits == 1, F.when(F.col("matched"), 1).otherwise(F.col("rank") + 1)).otherwise(F.col("rank")))
    chosen = ranked.groupBy(key).agg(F.min_by("url", "rank").alias("primary_paper"), F.min_by("candidate", "rank").alias("_id"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("_urls"))
    chosen = chosen.withColumn("secondary_papers", F.filter(F.array_distinct("_urls"), lambda u: u != F.col("primary_paper"))).drop("_urls")
    repos = rank_github(cards, key, text_col, model_col)
    if papers is not None:
        bare = cards.select(key, model_col).join(chosen.select(key, "_id"), key).join(repos.filter("is_primary").select(key), key, "left_anti")
        abstracts = bare.join(papers.select(F.col("arxiv_id").alias("_id"), F.concat_ws(" ", "title", "summary").alias("_told")), "_id")
        found = abstracts.select(key, model_col, F.array_join(L.abstract_github_links(F.col("_told")), "\n").alias("_told"))
        fallback = rank_github(found.withColumn("_told", F.regexp_replace("_told", "(?m)^github", "https://github")), key, "_told", model_col)
        repos = repos.join(fallback.select(key).distinct(), key, "left_anti").unionByName(fallback)
    git = repos.groupBy(key).agg(
        F.max(F.when(F.col("is_primary"), F.col("link"))).alias("primary_github"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_primary"), F.struct("pos", "link")))), lambda x: x["link"]).alias("secondary_github"),
    )
    git = git.filter("primary_github is not null") if with_repository else git
    return chosen.drop("_id").join(git, key, "inner" if with_repository else "left").withColumn("secondary_github", F.coalesce("secondary_github", F.array().cast("array<string>")))
