"""Named queries: each applies operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import markup, values
from ..functions import text as T
from ..operators import assemble, cards, classify, documents, placeholders, ranking, scoring, tuning
from ..shipping import ship
from ..sources.readers import read_table, spread
from ..sources.retrieval import repository_files
from . import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.cards(spark, docs(spark, sf_dir))


def paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.papers(spark, docs(spark, sf_dir))


def digest(items: Column) -> Column:
    return F.md5(F.array_join(items, "\n").cast("binary"))


def gathered(rows: DataFrame, key: str, *order: str, value: str = "text") -> DataFrame:
    """(key, n, digest) of a group's texts in order."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias("t")).select(key, F.size("t").cast("long").alias("n"), digest(F.col("t")).alias("digest"))


# --- gates and text --------------------------------------------------------------------------------
@query
def flagship(spark, sf_dir):
    """Gate, sentences, filters and cleaning, counted by language and source."""
    kept = documents.language_gate(docs(spark, sf_dir))
    clean = F.filter(F.transform(T.kept_sentences(F.col("text")), T.clean_item), lambda s: (s != "") & ~T.is_bibliography(s))
    return kept.select("lang", "source", F.explode(clean).alias("s")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


@query
def gate_ascii_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.looks_english(F.col("text")).alias("looks_english"), F.round(T.ascii_letter_ratio(F.col("text")), 6).alias("ratio"))


@query
def gate_language(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.declared_english(F.array("lang")).alias("declared"), T.passes_language_gate(F.array("lang"), F.col("text")).alias("passes"))


@query
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(F.filter("s", lambda x: T.has_min_words(x))).cast("long").alias("n_long"), digest(F.col("s")).alias("digest"))


@query
def abbreviation_guard(spark, sf_dir):
    return paper_rows(spark, sf_dir).select("doc_id", T.guarded_sentences(F.col("paper")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), digest(F.col("s")).alias("digest"))


@query
def table_row_filter(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_table_row(F.col("line"))).alias("n_table"), F.count_if(T.has_min_words(F.col("line"))).alias("n_long"))


@query
def clean_text(spark, sf_dir):
    lines = card_rows(spark, sf_dir).select("doc_id", F.filter(F.transform(F.split("card", "\n"), T.clean_item), lambda x: x != "").alias("t"))
    return lines.select("doc_id", F.size("t").cast("long").alias("n"), digest(F.col("t")).alias("digest"))


@query
def bibliography_filter(spark, sf_dir):
    kept = paper_rows(spark, sf_dir).select("doc_id", F.filter(F.split("paper", "\n"), lambda x: ~T.is_bibliography(x)).alias("t"))
    return kept.select("doc_id", F.size("t").cast("long").alias("n"), digest(F.col("t")).alias("digest"))


@query
def metadata_filter(spark, sf_dir):
    head = F.concat(F.lit("language: "), F.col("lang"), F.lit(" license: mit"))
    items = card_rows(spark, sf_dir).select("doc_id", F.concat(F.array(head), F.split("card", "\n")).alias("t"))
    kept = items.select("doc_id", F.filter("t", lambda x: ~T.is_metadata(x)).alias("t"))
    return kept.select("doc_id", F.size("t").cast("long").alias("n"), digest(F.col("t")).alias("digest"))


@query
def front_matter_strip(spark, sf_dir):
    c = F.col("card")
    return card_rows(spark, sf_dir).select("doc_id", F.md5(T.strip_front_matter(c).cast("binary")).alias("by_dashes"), F.md5(T.strip_yaml_block(c).cast("binary")).alias("by_lines"))


@query
def link_placeholders(spark, sf_dir):
    lines = card_rows(spark, sf_dir).select("doc_id", F.posexplode(F.split("card", "\n")).alias("pos", "text"))
    return gathered(placeholders.number_in_document(lines, T.BARE_URL, "LINK"), "doc_id", "pos")


@query
def shortcodes(spark, sf_dir):
    text = F.concat(F.lit(":smile: at 10:30:45 "), F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.strip_shortcodes(text).cast("binary")).alias("digest"))


# --- papers ------------------------------------------------------------------------------------------
@query
def heading_sections(spark, sf_dir):
    return documents.heading_sections(paper_rows(spark, sf_dir), text_col="paper").groupBy("doc_id", "section_ord", "heading").agg(F.count(F.lit(1)).alias("n"), digest(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("digest"))


@query
def section_filter(spark, sf_dir):
    sections = documents.heading_sections(paper_rows(spark, sf_dir), text_col="paper").groupBy("doc_id", "section_ord", "heading").agg(F.count(F.lit(1)).alias("n"))
    return documents.wanted_sections(sections)


@query
def span_merge(spark, sf_dir):
    return paper_rows(spark, sf_dir).select("doc_id", T.merge_spans(F.split("paper", "\n")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), digest(F.col("t")).alias("digest"))


@query
def paper_levels(spark, sf_dir):
    rows = documents.preprocess_papers(paper_rows(spark, sf_dir), text_col="paper")
    return rows.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def layout_tree(spark, sf_dir):
    node = lambda kind, html: F.struct(F.lit(kind).alias("block_type"), html.alias("html"))
    tree = F.to_json(F.struct(F.array(node("SectionHeader", F.lit("<h2>1.2 Data</h2>")), node("Text", F.concat(F.lit("<p>Doc "), F.col("doc_id").cast("string"), F.lit(" at https://x.example.org/a <math>a+b</math></p>"))), node("Equation", F.lit("<math>c</math>")), node("Text", F.concat(F.lit("<p>"), F.coalesce("text", F.lit("")), F.lit("</p>")))).alias("children")))
    rows = documents.layout_sections(docs(spark, sf_dir).select("doc_id", tree.alias("tree")))
    return rows.select("doc_id", "section_ord", "heading", F.size("blocks").cast("long").alias("n"), digest(F.col("blocks")).alias("digest"), F.array_join("math", " ").alias("math"), F.array_join("links", " ").alias("links"))


# --- markdown and pages ------------------------------------------------------------------------------
@query
def markdown_blocks(spark, sf_dir):
    got = documents.parse_markdown(card_rows(spark, sf_dir), text_col="card")
    return got.select("doc_id", F.size("sections").alias("n_sections"), F.size("paragraphs").alias("n_paragraphs"), digest(F.col("paragraphs")).alias("digest"), F.array_join("links", " ").alias("links"), F.array_join("emails", " ").alias("emails"))


@query
def markdown_levels(spark, sf_dir):
    rows = documents.preprocess_markdown(card_rows(spark, sf_dir), text_col="card")
    return rows.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def table_summaries(spark, sf_dir):
    card = F.concat(F.lit("## Results of it\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nThe table above shows all of the results.\n\n"), F.coalesce("text", F.lit("")))
    rows = documents.preprocess_markdown_tables(docs(spark, sf_dir).select("doc_id", card.alias("text")))
    return rows.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("text", F.lit("Table of "))).alias("n_tables"))


@query
def page_text(spark, sf_dir):
    text = F.regexp_replace(markup.html_to_text(F.col("html")), r"\s+", " ")
    return read_table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query
def unicode_fold(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", markup.nfkd(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"))


# --- links ---------------------------------------------------------------------------------------------
@query
def arxiv_ids(spark, sf_dir):
    return card_rows(spark, sf_dir).select("doc_id", F.posexplode(F.array_distinct(L.arxiv_ids(F.col("card")))).alias("pos", "arxiv_id")).withColumn("url", L.arxiv_pdf_url(F.col("arxiv_id")))


@query
def github_links(spark, sf_dir):
    return card_rows(spark, sf_dir).select("doc_id", F.posexplode(L.github_links(F.col("card"))).alias("pos", "link"))


@query
def github_parts(spark, sf_dir):
    return card_rows(spark, sf_dir).select("doc_id", F.explode(L.github_links(F.col("card"))).alias("link")).select("doc_id", "link", L.github_parts(F.col("link")).alias("g")).select("doc_id", "link", "g.owner", "g.repo")


@query
def labelled_refs(spark, sf_dir):
    c = F.col("card")
    return card_rows(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(L.labelled_paper_refs(c)), " ").alias("papers"), F.array_join(F.array_sort(L.labelled_repos(c)), " ").alias("repos"))


@query
def other_papers(spark, sf_dir):
    text = F.concat(F.lit("https://aclanthology.org/P"), F.col("doc_id").cast("string"), F.lit("/ https://openaccess.thecvf.com/c/html/x"), F.col("doc_id").cast("string"), F.lit(".html "), F.col("card"))
    return card_rows(spark, sf_dir).select("doc_id", F.posexplode(L.other_paper_urls(text)).alias("pos", "p")).select("doc_id", "pos", F.col("p.id").alias("id"), F.col("p.url").alias("url"))


@query
def bibtex_ids(spark, sf_dir):
    entry = F.concat(F.lit("@article{a"), F.col("doc_id").cast("string"), F.lit(",\n title={T},\n eprint={2101."), F.lpad((F.col("doc_id") % 99991).cast("string"), 5, "0"), F.lit("},\n archivePrefix={arXiv}\n}\n"), F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.explode(markup.arxiv_ids_of_bibtex(entry)).alias("arxiv_id"))


@query
def paper_rank(spark, sf_dir):
    return ranking.rank_papers(card_rows(spark, sf_dir), bibtex=False)


@query
def github_rank(spark, sf_dir):
    return ranking.rank_github(card_rows(spark, sf_dir))


@query
def link_selection(spark, sf_dir):
    rows = ranking.select_links(card_rows(spark, sf_dir), bibtex=False)
    return rows.select("doc_id", "primary_paper", "primary_github", F.array_join("secondary_papers", " ").alias("secondary_papers"))


@query
def title_match(spark, sf_dir):
    rows = card_rows(spark, sf_dir)
    found = ranking.paper_candidates(rows, bibtex=False)
    told = found.select(F.col("candidate").alias("arxiv_id")).distinct().select("arxiv_id", F.concat(F.lit("On model-"), F.substring("arxiv_id", 9, 2)).alias("title"), F.lit("A base of many models.").alias("summary"))
    got = ranking.match_titles(found.join(rows.select("doc_id", "model_id"), "doc_id"), told)
    return got.select("doc_id", "candidate", "matched")


@query
def normalise_link(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", L.normalise_link(F.col("url")).alias("link"))


@query
def id_tokens(spark, sf_dir):
    return card_rows(spark, sf_dir).select("doc_id", F.array_join(L.tokens(F.lower("model_id")), " ").alias("tokens"))


# --- classification ---------------------------------------------------------------------------------------
def _paragraphs(spark, sf_dir):
    lines = card_rows(spark, sf_dir).select("doc_id", F.posexplode(F.split("card", "\n")).alias("pos", "text"))
    return lines.filter("trim(text) <> ''")


@query
def keyword_classify(spark, sf_dir):
    return classify.classify_by_keywords(_paragraphs(spark, sf_dir)).drop("text")


def _centroids(spark, sf_dir):
    return classify.label_centroids(read_table(spark, sf_dir, "embeddings"))


def _tops(spark, sf_dir):
    scored = classify.with_centroid_scores(read_table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir))
    return classify.top_two(scored).withColumnRenamed("label", "truth").drop("embedding")


def _keyword_scores() -> tuple[Column, Column]:
    """Stand-ins for keyword scores of vectors, which have no text."""
    return F.col("vec_id") % 3, F.col("vec_id") % 5


def _swaps(spark, sf_dir):
    return _tops(spark, sf_dir).withColumn("swapped", tuning.reranked(*_keyword_scores()))


def _labels(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("label").distinct()


@query
def label_centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query
def centroid_top2(spark, sf_dir):
    return _tops(spark, sf_dir).select("vec_id", "label1", "label2", F.round("score1", 6).alias("score1"), F.round("score2", 6).alias("score2"))


@query
def gap_rerank_rule(spark, sf_dir):
    got = classify.apply_rerank(_tops(spark, sf_dir), *_keyword_scores(), 0.01, ((1, 2), (3, 4)))
    confidence = F.when(F.col("final_label") == F.col("label2"), F.col("confidence2")).otherwise(F.col("confidence1"))
    return got.select("vec_id", "final_label", "rule", F.round(confidence, 6).alias("confidence"))


@query
def macro_f1(spark, sf_dir):
    rows = _tops(spark, sf_dir).withColumn("predicted", F.col("label1"))
    return tuning.f1_by_label(rows, _labels(spark, sf_dir)).select("label", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), F.round("f1", 6).alias("f1"))


@query
def threshold_search(spark, sf_dir):
    return tuning.threshold_scores(_swaps(spark, sf_dir), _labels(spark, sf_dir)).select("step", F.round("macro_f1", 6).alias("macro_f1"))


@query
def pair_impact(spark, sf_dir):
    return tuning.pair_impact(_swaps(spark, sf_dir), 0.01)


@query
def stratified_split(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").withColumn("label", F.col("quality") * 2 + F.col("toxic"))
    return tuning.stratified_split(rows).select("doc_id", "label", "part")


@query
def rule_tuning(spark, sf_dir):
    got = tuning.tune(_swaps(spark, sf_dir), _labels(spark, sf_dir), "vec_id")
    return got.measures.select("part", "rows", F.round("baseline", 6).alias("baseline"), F.round("tuned", 6).alias("tuned"), F.round("threshold", 3).alias("threshold"))


@query
def tuning_status(spark, sf_dir):
    """C17: the status of the tuning, with the pairs it found."""
    got = tuning.tune(_swaps(spark, sf_dir), _labels(spark, sf_dir), "vec_id").status()
    pairs = F.array_join(F.transform("beneficial_pairs", lambda p: F.concat(p["label1"].cast("string"), F.lit(">"), p["label2"].cast("string"))), " ")
    scores = [F.round(c, 6).alias(c) for c in ("baseline_validation", "baseline_test", "tuned_validation", "tuned_test")]
    return got.select("tuned", "method", F.round("threshold", 3).alias("threshold"), F.col("rows_validation"), F.col("rows_test"), *scores, pairs.alias("beneficial_pairs"))


# --- references, scores, cards -------------------------------------------------------------------------------
def _turns(spark, sf_dir):
    source = F.when(F.col("role") == "user", "model_card").when(F.col("role") == "assistant", "paper").otherwise(F.col("role"))
    return read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("model_id"), source.alias("source"), F.col("turn").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("turn") % 2 == 0, "Training").otherwise("Evaluation").alias("predicted_label"))


@query
def grouped_references(spark, sf_dir):
    return assemble.grouped_references(_turns(spark, sf_dir)).select("model_id", "section", F.size("items").cast("long").alias("n"), digest(F.col("items")).alias("digest"))


@query
def label_counts(spark, sf_dir):
    return assemble.label_counts(_turns(spark, sf_dir)).drop("n_reranked")


@query
def assemble_card(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    got = assemble.assemble_cards(assemble.grouped_references(turns), turns)
    return got.select("model_id", "n_empty", F.md5(F.col("full_markdown").cast("binary")).alias("digest"))


def _items(spark, sf_dir):
    """Checklist items of each document: some points, one twice, one with an unknown score."""
    k = F.col("doc_id")
    item = lambda section, ord_, point, score: F.struct(F.lit(section).alias("section"), F.lit(ord_).alias("ord"), point.cast("int").alias("point_number"), F.lit("q").alias("evidence_quote"), F.lit("r").alias("reasoning"), score.cast("string").alias("score"))
    made = F.array(item("Training", 0, F.lit(2), (k % 3) / 2), item("Training", 1, F.lit(2), (k % 2) / 2), item("Training", 2, F.lit(5), F.lit("0.7")), item("Evaluation", 0, 13 + k % 4, F.lit("1")), item("Files", 0, F.lit(19), F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit("0.5"))))
    return docs(spark, sf_dir).select(k.cast("string").alias("model_id"), F.explode(made).alias("i")).select("model_id", "i.*")


@query
def checklist_scores(spark, sf_dir):
    items = _items(spark, sf_dir)
    filled = scoring.fill_and_score(items, items)
    by_section = scoring.section_scores(filled).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_sections"), F.round(F.sum("score"), 3).alias("section_sum"))
    return by_section.join(scoring.total_scores(filled), "model_id")


@query
def score_prompts(spark, sf_dir):
    refs = assemble.grouped_references(_turns(spark, sf_dir), tagged=False)
    got = scoring.build_prompts(refs)
    return got.select("model_id", "section", F.length("prompt").cast("long").alias("n_chars"))


@query
def llm_output_parse(spark, sf_dir):
    text = F.concat(F.lit("```json\n[{'point_number': "), (F.col("doc_id") % 22 + 1).cast("string"), F.lit(", 'score': 0.5, 'evidence_quote': 'q'}]\n```"))
    answers = docs(spark, sf_dir).select(F.col("doc_id").alias("model_id"), F.lit("Training").alias("section"), text.alias("answer"))
    return scoring.read_answers(answers).select("model_id", "section", "point_number", values.score_or_zero(F.col("score")).alias("score"))


@query
def keyed_cache_join(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(F.col("url").alias("link"), F.col("page_id").alias("row_id"), F.length("html").alias("payload"))
    models = docs(spark, sf_dir).select(F.col("source").alias("model_id"), F.col("doc_id").alias("row_id"), F.col("n_chars").alias("payload"))
    cached = cards.keyed_cache(models, F.col("model_id"), "row_id").select(F.col("cache_key").alias("model_id"), F.col("row_id").alias("card_row"), F.col("payload").alias("card"))
    by_link = cards.keyed_cache(pages.withColumn("k", L.normalise_link(F.col("link"))).filter("k <> ''"), F.col("k"), "row_id").select(F.col("cache_key").alias("link"), F.col("row_id").alias("page_row"), F.col("payload").alias("page"))
    wanted = read_table(spark, sf_dir, "pages").select("page_id", L.normalise_link(F.col("url")).alias("link"), F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("model_id"))
    return wanted.join(by_link, "link", "left").join(cached, "model_id", "left").select("page_id", "link", "model_id", "page_row", "page", "card_row", "card")


@query
def card_list(spark, sf_dir):
    listed = docs(spark, sf_dir).select(F.concat(F.lit("Org/"), F.col("source"), F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("model_id"), F.col("lang").alias("task"), F.col("doc_id").alias("row_id"))
    scores = read_table(spark, sf_dir, "labels").join(listed.withColumnRenamed("row_id", "doc_id"), "doc_id").groupBy("model_id").agg(F.max(cards.score_column(F.col("quality"))).alias("score"))
    return cards.card_list(listed, scores)


@query
def report_view(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("source").alias("model_id"), (F.col("n_chars") % 23).cast("string").alias("total_score"), F.lit(None).cast("map<string,double>").alias("section_scores"), F.create_map(F.lit("Training"), (F.col("doc_id") % 7).cast("double")).alias("scores_by_section"), F.lit(None).cast("boolean").alias("success"), F.col("doc_id").alias("row_id"))
    got = cards.normalise_reports(rows)
    return got.select("model_id", cards.score_column(F.col("total_score")).alias("score"), F.element_at("section_scores", "Training").alias("training"), "success")


def _entries(spark, sf_dir):
    """Links of each card as numbered placeholders of two sources."""
    rows = card_rows(spark, sf_dir).select("doc_id", F.posexplode(L.find_all(F.col("card"), T.BARE_URL)).alias("pos", "value"))
    return rows.select(F.col("doc_id").alias("model_id"), F.when(F.col("pos") % 3 == 2, "paper").otherwise("model_card").alias("source"), F.lit("LINK").alias("kind"), "pos", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit(":LINK]")).alias("token"), "value")


@query
def placeholder_canonical(spark, sf_dir):
    return placeholders.canonical_placeholders(_entries(spark, sf_dir))


@query
def placeholder_apply(spark, sf_dir):
    """Numbered cards get their addresses back by name; the round trip gives the card again."""
    rows = card_rows(spark, sf_dir)
    lines = rows.select("doc_id", F.lit(0).alias("pos"), F.col("card").alias("text"))
    numbered = placeholders.number_in_document(lines, T.BARE_URL, "LINK")
    canonical = placeholders.canonical_placeholders(_entries(spark, sf_dir).withColumn("source", F.lit("model_card")))
    names, held = placeholders.token_maps(canonical), placeholders.value_maps(canonical)
    joined = numbered.join(names.withColumnRenamed("model_id", "doc_id"), "doc_id", "left").join(held.withColumnRenamed("model_id", "doc_id"), "doc_id", "left")
    back = joined.withColumn("named", placeholders.namespace_tokens(F.col("text"), F.col("names"))).withColumn("back", placeholders.apply_replacements(F.col("named"), F.col("values")))
    return back.select("doc_id", F.md5(F.col("back").cast("binary")).alias("digest"), F.regexp_count("named", F.lit(r"\[MC_\d+:LINK\]")).cast("long").alias("n_named"))


@query
def resolve_sections(spark, sf_dir):
    text = F.concat(F.lit("See [0:LINK] [RP]. Run [PP_0:CODE] or $MC_0:LINK$.\n```\n[GH_0:CODE]\n```\n"), F.coalesce("text", F.lit("")))
    payload = F.lit('{"MC": {"links": ["https://a.example"]}, "RP": {"links": ["https://b.example"]}, "GH": {"codes": ["```py\\nrun()\\n```"]}}')
    held = F.create_map(F.lit("[MC_9:LINK]"), F.lit("x"))
    got = docs(spark, sf_dir).select("doc_id", placeholders.resolve_card_text(text, F.lit("Training"), held, payload).alias("t"))
    return got.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.substring("t", 1, 80).alias("head"))


@query
def payload_json(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("json"))


@query
def parse_cells(spark, sf_dir):
    cell = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("['a', 'b"), F.col("doc_id").cast("string"), F.lit("']"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('["a", "'), F.col("source"), F.lit('"]'))).otherwise(F.when(F.col("doc_id") % 2 == 0, F.lit("NaN")).otherwise(F.col("source")))
    return docs(spark, sf_dir).select("doc_id", values.parse_text_list(cell).alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("items"))


@query
def source_lookup(spark, sf_dir):
    """R10 over every document's source as a section name."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.array_join(values.source_priority(F.when(F.col("doc_id") % 4 == 0, "How to use").when(F.col("doc_id") % 4 == 1, "Training").otherwise("Other"), F.when(F.col("doc_id") % 5 == 0, "MATH").otherwise("LINK"), F.when(F.col("doc_id") % 7 == 0, F.lit("RP"))), " ").alias("priority"))


@query
def repository_tree(spark, sf_dir):
    trees = docs(spark, sf_dir).select(F.col("source").alias("repo"), F.when(F.col("doc_id") % 2 == 0, "master").otherwise("main").alias("branch"), F.when(F.col("doc_id") % 5 == 0, "tree").otherwise("blob").alias("kind"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    return repository_files(trees).select("repo", F.size("files").cast("long").alias("n"), digest(F.col("files")).alias("digest"))


@query
def first_links(spark, sf_dir):
    """Each document's first link, and its ordinal among the links of its source's documents."""
    rows = card_rows(spark, sf_dir).select("doc_id", "model_id", F.get(L.find_all(F.col("card"), T.BARE_URL), F.lit(0)).alias("link")).filter("link is not null")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("model_id").orderBy("doc_id"))).select("doc_id", "model_id", "link", "ordinal")

