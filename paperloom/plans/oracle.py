"""DuckDB counterparts of the named queries, on the same tables."""

from __future__ import annotations

from ..functions import links as L
from ..functions import text as T
from ..operators.lexicon import CHECKLIST, LABELS, PHRASES
from ..operators.scoring import INSTRUCTIONS
from . import derived

CARD, PAPER = derived.in_duckdb(derived.CARD), derived.in_duckdb(derived.PAPER)
DIGEST = "md5(array_to_string({0}, chr(10)))"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def table_row(x: str) -> str:
    t = trimmed(x)
    return f"((starts_with({t}, '|') AND ends_with({t}, '|')) OR length({t}) - length(replace({t}, '|', '')) >= 3)"


def sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '\s', '', 'g') <> '')"


def protected(x: str) -> str:
    for a in T.ABBREVIATIONS:
        x = f"replace({x}, {q(a)}, {q(a.replace('.', '~'))})"
    return x.replace("~'", "' || chr(2)").replace("~", "' || chr(2) || '")


def guarded(x: str) -> str:
    return f"list_transform({sentences(protected(x))}, lambda s: {trimmed('replace(s, chr(2), chr(46))')})"


def kept_sentences(x: str, placeholder: str = T.PAPER_PLACEHOLDER) -> str:
    return f"list_filter({guarded(x)}, lambda s: NOT {table_row('s')} AND NOT regexp_matches(s, {q(placeholder)}) AND {words('s')} > 3)"


def cleaned(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, {q(T.CITE_BRACKET)}, '', 'g'), {q(T.CITE_INLINE)}, '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, {q(T.QUOTED_ITEM)}, '\1', 'g'), '\s+', ' ', 'g'))"


def bibliography(x: str) -> str:
    """As the query: edges of words of any script, ASCII case (the two other letters that fold to ASCII ones are put out of the way), VT as white space."""
    signs = [T.word_edges(p, f"(?:^|[^{T.WORD[1:]})", f"(?:$|[^{T.WORD[1:]})", T.WORD).replace(r"\s", r"[\s\x0B]") for p in T.BIBLIOGRAPHY]
    return f"(regexp_matches(translate({x}, '\u017f\u212a', '\u00f8\u00f8'), {q('(?i)(?:' + '|'.join(signs) + ')')}) AND (length({x}) - length(replace({x}, ',', '')) >= 3 OR length({x}) > 100))"


def metadata(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q('(?i)' + '|'.join(k.replace('.', chr(92) + '.') for k in T.METADATA_KEYS))})) >= 2"


def find_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


ARXIV_IDS = f"list_concat({find_all('card', L.ARXIV_URL, 2)}, {find_all('card', L.HUB_PAPER_URL, 1)})"


def distinct_in_order(x: str) -> str:
    """The first of each value, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def github_links(x: str) -> str:
    strip = "regexp_replace({0}, '[.,;:!?)\"'']+$', '')"
    low = lambda v: f"lower(rtrim({v}, '/'))"

    def cut(v: str, segments: tuple[str, ...]) -> str:
        cases = " ".join(f"WHEN strpos({low(v)}, {q(s)}) > 0 THEN substr({v}, 1, strpos({low(v)}, {q(s)}) - 1)" for s in segments)
        return f"(CASE {cases} ELSE {v} END)"

    links = f"list_transform({find_all(x, L.GITHUB)}, lambda u: {strip.format('u')})"
    links = f"list_filter({links}, lambda u: NOT regexp_matches({low('u')}, {q(chr(92) + '.(' + '|'.join(L.ASSET_EXTENSIONS) + ')$')}))"
    links = f"list_transform({links}, lambda u: {cut('u', ('/blob/', '/raw/'))})"
    links = f"list_transform({links}, lambda u: {cut('u', L.PAGE_SEGMENTS)})"
    path = "trim(regexp_replace(lower(rtrim(u, '/')), 'https?://github\\.com/?', ''), '/')"
    return f"list_filter({links}, lambda u: contains({path}, '/'))"


def labelled_papers(x: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda l: regexp_matches({trimmed('l')}, {q(L.PAPER_LABEL)}))"
    urls = f"list_filter(list_transform({find_all('l', L.URL)}, lambda u: rtrim(u, '/')), lambda u: NOT contains(lower(u), 'arxiv.org'))"
    return f"list_distinct(flatten(list_transform({lines}, lambda l: list_concat({find_all('l', L.ARXIV_ID, 1)}, {urls}))))"


def labelled_repos(x: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(l, {q(L.GITHUB_LABEL)}))"
    return f"list_distinct(flatten(list_transform({lines}, lambda l: list_transform({find_all('l', L.GITHUB_REPO)}, lambda u: regexp_replace(lower(u), '^https?://github\\.com/', '')))))"


#: DuckDB's expressions know no lookahead; identifiers here are lower-case, where its branch never matches.
LOWER_TOKEN = r"\d+[a-z]+(?:[\d.]*)|[a-z]+(?:[\d.]*)|\d+"


def tokens(x: str) -> str:
    return f"flatten(list_transform(regexp_split_to_array({x}, '[-_./]'), lambda s: CASE WHEN len({find_all('s', LOWER_TOKEN)}) > 0 THEN {find_all('s', LOWER_TOKEN)} ELSE [s] END))"


def normalised(x: str) -> str:
    s = f"trim(coalesce({x}, ''))"
    out = f"rtrim(replace(split_part(split_part({s}, '#', 1), '?', 1), 'http://', 'https://'), '/')"
    out = f"regexp_replace(replace(regexp_replace({out}, '\\.git$', ''), 'https://arxiv.org/pdf/', 'https://arxiv.org/abs/'), '\\.pdf$', '')"
    return f"CASE WHEN lower({s}) IN ('', 'nan', 'none', 'null') THEN '' ELSE lower({out}) END"


def keyword_score(x: str, phrases: tuple[str, ...]) -> str:
    several, single = [p for p in phrases if " " in p], [p for p in phrases if " " not in p]
    parts = ["CAST(0 AS DOUBLE)"]
    if several:
        parts.append(f"len(list_filter([{', '.join(map(q, several))}], lambda p: contains(lower({x}), p)))")
    if single:
        parts.append(f"len(list_intersect(list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z0-9\\-]+')), [{', '.join(map(q, single))}]))")
    return " + ".join(parts)


HEADING_LINES = rf"""
    l AS (SELECT doc_id, generate_subscripts(string_split(paper, chr(10)), 1) - 1 AS pos, {trimmed("unnest(string_split(paper, chr(10)))")} AS line FROM ({PAPER})),
    h AS (SELECT *, regexp_matches(line, {q(T.HEADING)}) AND {words("line")} <= 10 AS is_head FROM l WHERE line <> ''),
    g AS (SELECT *, coalesce(last_value(CASE WHEN is_head THEN lower(trim(CASE WHEN regexp_matches(line, {q(T.NUMBERED_HEADING)}) THEN regexp_extract(line, {q(T.NUMBERED_HEADING)}, 2) ELSE line END)) END IGNORE NULLS) OVER w, 'N/A') AS heading,
        CASE WHEN is_head THEN 0 ELSE len(regexp_extract_all(line, {q(T.BARE_URL)})) END AS n_links FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, heading) AS section_ord, sum(n_links) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - n_links AS base FROM g)
"""


def numbered(text: str, base: str) -> str:
    """Addresses of a text become [n:LINK], n counting on from ``base``."""
    cut = f"string_split(regexp_replace({text}, {q(T.BARE_URL)}, chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({cut}, lambda p, i: CASE WHEN i = 1 THEN p ELSE '[' || CAST({base} + i - 2 AS BIGINT) || ':LINK]' || p END), '')"


UNWANTED = " OR ".join(f"contains(heading, {q(x)})" for x in T.UNWANTED_SECTIONS)
ENDED = q("(?:[.!?]|\\]|[.!?][\"'”’)\\]]*)$")

CENTROIDS = """
    e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    p AS (SELECT label, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM e),
    m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY ALL),
    c AS (SELECT label, list(x ORDER BY pos) AS c, sqrt(sum(x * x)) AS n FROM m GROUP BY label),
    s AS (SELECT vec_id, e.label AS truth, c.label, list_dot_product(v, c.c) / c.n / sqrt(list_dot_product(v, v)) AS score FROM e, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s),
    t AS (SELECT vec_id, truth, max(label) FILTER (k = 1) AS label1, max(score) FILTER (k = 1) AS score1, max(label) FILTER (k = 2) AS label2, max(score) FILTER (k = 2) AS score2 FROM r GROUP BY vec_id, truth),
    w AS (SELECT *, CASE WHEN vec_id % 5 > vec_id % 3 THEN label2 ELSE label1 END AS swapped FROM t)
"""


def f1(rows: str, keys: str = "") -> str:
    """(keys, label, f1) of rows (keys, truth, predicted)."""
    k = f"{keys}, " if keys else ""
    names = f"(SELECT DISTINCT {k}label FROM (SELECT DISTINCT label FROM embeddings), (SELECT DISTINCT {keys or '1'} FROM {rows}))"
    match = f"AND {' AND '.join(f'x.{c.strip()} = n.{c.strip()}' for c in keys.split(','))}" if keys else ""
    return f"""SELECT {', '.join('n.' + c.strip() for c in keys.split(',')) + ', ' if keys else ''}n.label,
        count(*) FILTER (x.truth = n.label AND x.predicted = n.label) AS tp, count(*) FILTER (x.truth <> n.label AND x.predicted = n.label) AS fp, count(*) FILTER (x.truth = n.label AND x.predicted <> n.label) AS fn
        FROM {names} n LEFT JOIN {rows} x ON (x.truth = n.label OR x.predicted = n.label) {match} GROUP BY ALL"""


F1_OF = "CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
STEPS = f"""steps AS (SELECT i AS step, truth, CASE WHEN score1 - score2 <= i * 0.001 + 1e-12 THEN swapped ELSE label1 END AS predicted FROM w, range(101) r(i))"""

TURNS = """SELECT CAST(conv_id AS VARCHAR) AS model_id, CASE role WHEN 'user' THEN 'model_card' WHEN 'assistant' THEN 'paper' ELSE role END AS source, turn AS pos, coalesce(text, '') AS text, CASE WHEN turn % 2 = 0 THEN 'Training' ELSE 'Evaluation' END AS section FROM conversations"""
TAG = "CASE source WHEN 'paper' THEN 'RP' WHEN 'model_card' THEN 'MC' WHEN 'github_readme' THEN 'GH' ELSE upper(source) END"
SOURCE_ORDER = "CASE source WHEN 'paper' THEN 0 WHEN 'model_card' THEN 1 WHEN 'github_readme' THEN 2 ELSE 3 END"
REFERENCES = f"r AS (SELECT model_id, section, list(text || ' [Source: ' || {TAG} || ']' ORDER BY {SOURCE_ORDER}, pos, text) AS items FROM ({TURNS}) GROUP BY ALL)"

ITEMS = """i AS (
    SELECT CAST(doc_id AS VARCHAR) AS model_id, unnest([
        {'section': 'Training', 'ord': 0, 'point': 2, 'score': (doc_id % 3) / 2.0}, {'section': 'Training', 'ord': 1, 'point': 2, 'score': (doc_id % 2) / 2.0},
        {'section': 'Training', 'ord': 2, 'point': 5, 'score': 0.0}, {'section': 'Evaluation', 'ord': 0, 'point': 13 + doc_id % 4, 'score': 1.0},
        {'section': 'Files', 'ord': 0, 'point': 19, 'score': CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 0.5 END}], max_depth := 2) FROM documents)"""

LINES = f"SELECT doc_id, generate_subscripts(string_split(card, chr(10)), 1) - 1 AS pos, unnest(string_split(card, chr(10))) AS text FROM ({CARD})"
LIST_OF_LINES = "string_split({0}, chr(10))"
ENTRIES = f"""e AS (SELECT doc_id AS model_id, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS value FROM (SELECT doc_id, {find_all('card', T.BARE_URL)} AS u FROM ({CARD})))"""


def listing(expr: str, source: str, columns: str = "doc_id") -> str:
    """(columns, n, digest) of a list expression."""
    return f"SELECT {columns}, CAST(len(t) AS BIGINT) AS n, {DIGEST.format('t')} AS digest FROM (SELECT {columns}, {expr} AS t FROM {source})"


def prompt_head() -> str:
    """Characters of each section's prompt besides the references, and the section."""
    fixed = len("<checklist>\n") + len("\n</checklist>\n\n<reference_text>\n") + len("\n</reference_text>\n\n" + INSTRUCTIONS)
    return ", ".join(f"({q(s)}, {fixed + len(chr(10).join(items))})" for s, items in CHECKLIST.items())


REPR = "replace(replace(replace(replace(x, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"

ORACLE_SQL: dict[str, str] = {
    "flagship": f"""
        WITH k AS (SELECT lang, source, unnest({kept_sentences('text')}) AS s FROM documents WHERE length(text) < 50 OR coalesce(length(regexp_replace(substr(text, 1, 5000), '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(substr(text, 1, 5000), '[^\\p{{L}}]', '', 'g')), 0), 1.0) >= 0.70),
        c AS (SELECT lang, source, {cleaned('s')} AS s FROM k)
        SELECT lang, source, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM c WHERE s <> '' AND NOT {bibliography('s')} GROUP BY ALL""",
    "gate_ascii_ratio": r"""
        WITH r AS (SELECT doc_id, text, length(regexp_replace(substr(text, 1, 5000), '[^A-Za-z]', '', 'g')) / CAST(nullif(length(regexp_replace(substr(text, 1, 5000), '[^\p{L}]', '', 'g')), 0) AS DOUBLE) AS ratio FROM documents)
        SELECT doc_id, length(text) < 50 OR coalesce(ratio, 1.0) >= 0.70 AS looks_english, round(ratio, 6) AS ratio FROM r""",
    "gate_language": r"""
        WITH r AS (SELECT doc_id, text, CASE WHEN lang IS NULL OR trim(lang) = '' THEN NULL ELSE replace(lower(trim(lang)), '_', '-') IN ('en', 'eng', 'english') OR starts_with(replace(lower(trim(lang)), '_', '-'), 'en-') END AS declared,
            length(regexp_replace(substr(text, 1, 5000), '[^A-Za-z]', '', 'g')) / CAST(nullif(length(regexp_replace(substr(text, 1, 5000), '[^\p{L}]', '', 'g')), 0) AS DOUBLE) AS ratio FROM documents)
        SELECT doc_id, declared, coalesce(declared, length(text) < 50 OR coalesce(ratio, 1.0) >= 0.70) AS passes FROM r""",
    "sentence_split": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(list_filter(s, lambda x: {words('x')} > 3)) AS BIGINT) AS n_long, {DIGEST.format('s')} AS digest FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "abbreviation_guard": listing(guarded("paper"), f"({PAPER})"),
    "table_row_filter": f"SELECT doc_id, CAST(count(*) FILTER ({table_row('line')}) AS BIGINT) AS n_table, count(*) FILTER ({words('line')} > 3) AS n_long FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
    "clean_text": listing(f"list_filter(list_transform(string_split(card, chr(10)), lambda x: {cleaned('x')}), lambda x: x <> '')", f"({CARD})"),
    "bibliography_filter": listing(f"list_filter(string_split(paper, chr(10)), lambda x: NOT {bibliography('x')})", f"({PAPER})"),
    "metadata_filter": listing(f"list_filter(list_prepend('language: ' || lang || ' license: mit', string_split(card, chr(10))), lambda x: NOT {metadata('x')})", f"({CARD})"),
    "front_matter_strip": rf"""
        SELECT doc_id, md5(CASE WHEN starts_with(card, '---') AND strpos(substr(card, 4), '---') > 0 THEN substr(card, strpos(substr(card, 4), '---') + 6) ELSE card END) AS by_dashes,
               md5(regexp_replace(card, '(?s)\A\s*---\s*\n.*?\n(?:---|\.\.\.)[ \t]*\n?', '')) AS by_lines FROM ({CARD})""",
    "link_placeholders": f"""
        WITH l AS (SELECT *, len(regexp_extract_all(text, {q(T.BARE_URL)})) AS n FROM ({LINES})),
        b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - n AS base FROM l)
        SELECT doc_id, count(*) AS n, md5(string_agg({numbered('text', 'base')}, chr(10) ORDER BY pos)) AS digest FROM b GROUP BY doc_id""",
    "shortcodes": f"SELECT doc_id, md5(regexp_replace(':smile: at 10:30:45 ' || coalesce(text, ''), {q(T.SHORTCODE)}, '', 'g')) AS digest FROM documents",
    "heading_sections": f"WITH {HEADING_LINES} SELECT doc_id, section_ord, heading, count(*) AS n, md5(string_agg({numbered('line', 'base')}, chr(10) ORDER BY pos)) AS digest FROM s WHERE NOT is_head GROUP BY doc_id, section_ord, heading",
    "section_filter": f"""
        WITH {HEADING_LINES}, k AS (SELECT doc_id, section_ord, heading, count(*) AS n FROM s WHERE NOT is_head GROUP BY ALL),
        i AS (SELECT *, max(CASE WHEN heading = 'introduction' THEN section_ord END) OVER (PARTITION BY doc_id) AS start FROM k)
        SELECT doc_id, section_ord, heading, n FROM i WHERE (start IS NULL OR section_ord > start) AND NOT ({UNWANTED})""",
    "span_merge": rf"""
        WITH b AS (SELECT doc_id, string_split(paper, chr(10)) AS l FROM ({PAPER})),
        m AS (SELECT doc_id, list_reduce(list_prepend(regexp_replace(l[1], '\\[a-zA-Z0-9]+', '', 'g'), l[2:]), lambda a, x: CASE WHEN regexp_matches(regexp_replace(a, '\s+$', ''), {ENDED}) THEN a || chr(1) || regexp_replace(x, '\\[a-zA-Z0-9]+', '', 'g') ELSE a || ' ' || x END) AS t FROM b)
        SELECT doc_id, CAST(len(string_split(t, chr(1))) AS BIGINT) AS n, md5(replace(t, chr(1), chr(10))) AS digest FROM m""",
    "arxiv_ids": f"""
        WITH a AS (SELECT doc_id, {ARXIV_IDS} AS l FROM ({CARD})), d AS (SELECT doc_id, {distinct_in_order('l')} AS l FROM a)
        SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS arxiv_id, 'https://arxiv.org/pdf/' || unnest(l) || '.pdf' AS url FROM d""",
    "github_links": f"WITH a AS (SELECT doc_id, {github_links('card')} AS l FROM ({CARD})) SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS link FROM a",
    "github_parts": rf"""
        WITH a AS (SELECT doc_id, unnest({github_links('card')}) AS link FROM ({CARD})), b AS (SELECT *, string_split(trim(regexp_replace(regexp_replace(link, '\.git$', ''), '^(?:https?://)?(?:www\.)?github\.com/', ''), '/'), '/') AS p FROM a)
        SELECT doc_id, link, coalesce(p[1], '') AS owner, coalesce(p[2], '') AS repo FROM b""",
    "labelled_refs": f"SELECT doc_id, array_to_string(list_sort({labelled_papers('card')}), ' ') AS papers, array_to_string(list_sort({labelled_repos('card')}), ' ') AS repos FROM ({CARD})",
    "other_papers": f"""
        WITH a AS (SELECT doc_id, list_filter(list_transform({find_all("'https://aclanthology.org/P' || doc_id || '/ https://openaccess.thecvf.com/c/html/x' || doc_id || '.html ' || card", L.URL)}, lambda u: rtrim(u, '/')), lambda u: contains(u, 'anthology.org') OR contains(u, 'openaccess.thecvf.com')) AS l FROM ({CARD})),
        b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS id FROM a)
        SELECT *, CASE WHEN contains(id, 'anthology.org') THEN CASE WHEN ends_with(id, '.pdf') THEN id ELSE id || '.pdf' END ELSE replace(replace(id, '/html/', '/papers/'), '.html', '.pdf') END AS url FROM b""",
    "bibtex_ids": "SELECT doc_id, '2101.' || lpad(CAST(doc_id % 99991 AS VARCHAR), 5, '0') AS arxiv_id FROM documents",
    "paper_rank": f"""
        WITH a AS (SELECT doc_id, {ARXIV_IDS} AS l, CASE WHEN starts_with(card, '---') AND strpos(substr(card, 4), '---') > 0 THEN substr(card, strpos(substr(card, 4), '---') + 6) ELSE card END AS body FROM ({CARD})),
        d AS (SELECT doc_id, body, {labelled_papers('body')} AS labels, {distinct_in_order('l')} AS l FROM a),
        c AS (SELECT doc_id, body, labels, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS candidate FROM d),
        s AS (SELECT *, (length(body) - length(replace(body, candidate, ''))) / length(candidate) AS n, strpos(body, candidate) - 1 AS place FROM c),
        o AS (SELECT *, count(*) FILTER (place >= 0) OVER (PARTITION BY doc_id) - row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN place >= 0 THEN place END NULLS LAST, pos) + 1 AS ordinal FROM s),
        f AS (SELECT *, CAST(greatest(floor(n), 1) * 2 + CASE WHEN len(list_filter(labels, lambda x: contains(x, candidate) OR contains(candidate, x))) > 0 THEN 5 ELSE 0 END + CASE WHEN place >= 0 THEN round_even(ordinal * (1 + (1.0 - place / CAST(greatest(length(body), 1) AS DOUBLE))), 0) ELSE 0 END AS BIGINT) AS score FROM o)
        SELECT doc_id, candidate, 'https://arxiv.org/pdf/' || candidate || '.pdf' AS url, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM f""",
    "github_rank": rf"""
        WITH a AS (SELECT doc_id, {tokens('lower(model_id)')} AS model, {labelled_repos('card')} AS labelled, {github_links('card')} AS l FROM ({CARD})),
        d AS (SELECT doc_id, model, labelled, {distinct_in_order('l')} AS l FROM a),
        c AS (SELECT doc_id, model, labelled, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS link FROM d),
        p AS (SELECT *, string_split(trim(lower(regexp_replace(link, 'https?://github\.com/', '', 'g')), '/'), '/') AS p FROM c),
        r AS (SELECT *, CASE WHEN len(p) >= 2 THEN p[1] || '/' || p[2] END AS repo, CASE WHEN p[3] IN ('tree', 'blob', 'raw') THEN p[5:] ELSE p[3:] END AS extra FROM p),
        u AS (SELECT *, CASE WHEN len(extra) > 0 THEN repo || '/' || array_to_string(extra, '/') ELSE repo END AS path FROM r),
        s AS (SELECT *, 3 * len(list_intersect(list_distinct(model), list_distinct({tokens('path')}))) + CASE WHEN list_contains(labelled, repo) THEN 5 ELSE 0 END + CASE WHEN pos = 0 THEN 2 ELSE 0 END AS score FROM u),
        w AS (SELECT *, max(score) OVER d AS best, count(*) OVER d AS links, count(*) OVER e AS of_repo, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k, row_number() OVER (PARTITION BY doc_id, repo ORDER BY length(link), pos) AS short FROM s WINDOW d AS (PARTITION BY doc_id), e AS (PARTITION BY doc_id, repo))
        SELECT doc_id, pos, link, CAST(score AS BIGINT) AS score, coalesce(CASE WHEN best >= 3 THEN k = 1 ELSE of_repo > links / 2.0 AND short = 1 AND repo IS NOT NULL END, false) AS is_primary FROM w""",
    "title_match": f"""
        WITH a AS (SELECT doc_id, model_id, {ARXIV_IDS} AS l FROM ({CARD})), d AS (SELECT doc_id, model_id, {distinct_in_order('l')} AS l FROM a),
        c AS (SELECT doc_id, split_part(lower(model_id), '/', 2) AS name, unnest(l) AS candidate FROM d),
        t AS (SELECT *, lower('On model-' || substr(candidate, 9, 2) || ' A base of many models.') AS told FROM c)
        SELECT doc_id, candidate, contains(told, name) OR (length(split_part(name, '-', 1)) >= 3 AND contains(told, split_part(name, '-', 1))) AS matched FROM t""",
    "normalise_link": f"SELECT page_id, {normalised('url')} AS link FROM pages",
    "id_tokens": f"SELECT doc_id, array_to_string({tokens('lower(model_id)')}, ' ') AS tokens FROM ({CARD})",
    "keyword_classify": f"""
        WITH l AS (SELECT doc_id, pos, text FROM ({LINES}) WHERE trim(text) <> ''),
        k AS (SELECT doc_id, pos, [{', '.join(f"{{'n': -({keyword_score('text', PHRASES[x])}), 'o': {i}, 'l': {q(x)}}}" for i, x in enumerate(LABELS))}] AS s FROM l),
        r AS (SELECT doc_id, pos, list_sort(s) AS s, list_sum(list_transform(s, lambda x: -x.n)) AS total FROM k)
        SELECT doc_id, pos, s[1].l AS predicted_label, CASE WHEN total > 0 THEN round(-s[1].n / total, 4) ELSE 0.0 END AS confidence, s[2].l AS top2_label, -s[2].n AS top2_confidence FROM r""",
    "label_centroids": f"WITH {CENTROIDS} SELECT label, generate_subscripts(c, 1) - 1 AS pos, round(unnest(c) / n, 6) AS x FROM c",
    "centroid_top2": f"WITH {CENTROIDS} SELECT vec_id, label1, label2, round(score1, 6) AS score1, round(score2, 6) AS score2 FROM t",
    "gap_rerank_rule": f"""
        WITH {CENTROIDS}, z AS (SELECT *, score1 - score2 <= 0.01 OR (label1, label2) IN ((1, 2), (3, 4)) AS rule FROM w),
        f AS (SELECT *, CASE WHEN rule THEN swapped ELSE label1 END AS final_label FROM z),
        x AS (SELECT vec_id, label, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM s), y AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS confidence FROM x)
        SELECT f.vec_id, final_label, rule, round(confidence, 6) AS confidence FROM f JOIN y ON y.vec_id = f.vec_id AND y.label = final_label""",
    "macro_f1": f"WITH {CENTROIDS}, x AS (SELECT truth, label1 AS predicted FROM t), y AS ({f1('x')}) SELECT label, tp, fp, fn, round({F1_OF}, 6) AS f1 FROM y",
    "threshold_search": f"WITH {CENTROIDS}, {STEPS}, y AS ({f1('steps', 'step')}) SELECT CAST(step AS INTEGER) AS step, round(avg({F1_OF}), 6) AS macro_f1 FROM y GROUP BY step",
    "pair_impact": f"WITH {CENTROIDS} SELECT label1, label2, CAST(sum(CASE WHEN label1 <> truth AND swapped = truth THEN 1 WHEN label1 = truth AND swapped <> truth THEN -1 ELSE 0 END) AS BIGINT) AS impact FROM w WHERE score1 - score2 > 0.01 GROUP BY label1, label2 HAVING impact > 0",
    "stratified_split": """
        WITH l AS (SELECT doc_id, quality * 2 + toxic AS label FROM labels), r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42'), doc_id) AS k FROM l)
        SELECT doc_id, label, CASE WHEN k <= CASE WHEN n > 1 THEN greatest(1, least(n - 1, round_even(n * 0.6, 0))) ELSE n END THEN 'test' ELSE 'validation' END AS part FROM r""",
    "rule_tuning": f"""
        WITH {CENTROIDS}, n0 AS (SELECT *, count(*) OVER (PARTITION BY truth) AS n, row_number() OVER (PARTITION BY truth ORDER BY md5(vec_id || ':42'), vec_id) AS k FROM w),
        parts AS (SELECT *, CASE WHEN k <= CASE WHEN n > 1 THEN greatest(1, least(n - 1, round_even(n * 0.6, 0))) ELSE n END THEN 'test' ELSE 'validation' END AS part FROM n0),
        v AS (SELECT i AS step, truth, CASE WHEN score1 - score2 <= i * 0.001 + 1e-12 THEN swapped ELSE label1 END AS predicted FROM parts, range(101) r(i) WHERE part = 'validation'),
        y AS ({f1('v', 'step')}), z AS (SELECT step, avg({F1_OF}) AS f FROM y GROUP BY step), best AS (SELECT step * 0.001 AS threshold FROM z ORDER BY round(f, 12) DESC, step LIMIT 1),
        good AS (SELECT label1, label2, sum(CASE WHEN label1 <> truth AND swapped = truth THEN 1 WHEN label1 = truth AND swapped <> truth THEN -1 ELSE 0 END) AS impact FROM parts, best WHERE part = 'validation' AND score1 - score2 > threshold GROUP BY ALL HAVING impact > 0),
        told AS (SELECT part, truth, label1, CASE WHEN score1 - score2 <= threshold OR (label1, label2) IN (SELECT (label1, label2) FROM good) THEN swapped ELSE label1 END AS tuned FROM parts, best),
        xb AS (SELECT part, truth, label1 AS predicted FROM told), fb AS ({f1('xb', 'part')}), xa AS (SELECT part, truth, tuned AS predicted FROM told), fa AS ({f1('xa', 'part')}),
        b AS (SELECT part, avg({F1_OF}) AS f FROM fb GROUP BY part), a AS (SELECT part, avg({F1_OF}) AS f FROM fa GROUP BY part)
        SELECT part, count(*) AS rows, round(any_value(b.f), 6) AS baseline, round(any_value(a.f), 6) AS tuned, round(any_value(threshold), 3) AS threshold FROM told JOIN b USING (part) JOIN a USING (part), best GROUP BY part""",
    "grouped_references": f"WITH {REFERENCES} SELECT model_id, section, CAST(len(items) AS BIGINT) AS n, {DIGEST.format('items')} AS digest FROM r",
    "label_counts": f"SELECT model_id, source, count(*) AS n, count(DISTINCT section) AS n_labels FROM ({TURNS}) GROUP BY ROLLUP (model_id, source) HAVING model_id IS NOT NULL",
    "assemble_card": f"""
        WITH {REFERENCES}, m AS (SELECT DISTINCT model_id FROM ({TURNS})), s(o, label) AS (VALUES {', '.join(f'({i}, {q(x)})' for i, x in enumerate(LABELS))}),
        t AS (SELECT m.model_id, o, items, '### ' || label || chr(10) || chr(10) || CASE WHEN items IS NULL THEN '[More information needed]' ELSE array_to_string(list_transform(items, lambda x: '- ' || x), chr(10)) END AS text FROM m CROSS JOIN s LEFT JOIN r ON r.model_id = m.model_id AND r.section = label)
        SELECT model_id, count(*) FILTER (items IS NULL) AS n_empty, md5(string_agg(text, chr(10) || chr(10) ORDER BY o)) AS digest FROM t GROUP BY model_id""",
    "checklist_scores": f"""
        WITH {ITEMS}, c(section, o, k, point) AS (VALUES {', '.join(f"({q(s)}, {i}, {k}, {x.split(']')[0].split()[-1]})" for i, (s, items) in enumerate(CHECKLIST.items()) for k, x in enumerate(items))}),
        f AS (SELECT model_id, section, ord, point, CASE WHEN score IN (0, 0.5, 1) THEN score ELSE 0 END AS score FROM i UNION ALL SELECT m.model_id, c.section, c.k, c.point, 0 FROM (SELECT DISTINCT model_id FROM i) m, c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.model_id = m.model_id AND i.section = c.section)),
        s AS (SELECT model_id, section, round(sum(score), 3) AS score FROM f GROUP BY ALL), o AS (SELECT DISTINCT section, o FROM c),
        l AS (SELECT model_id, point, arg_max(score, o * 1000 + ord) AS score FROM f JOIN o USING (section) GROUP BY ALL), t AS (SELECT model_id, round(sum(score), 3) AS total_score FROM l GROUP BY model_id)
        SELECT model_id, count(*) AS n_sections, CAST(round(sum(score), 3) AS DOUBLE) AS section_sum, CAST(any_value(total_score) AS DOUBLE) AS total_score FROM s JOIN t USING (model_id) GROUP BY model_id""",
    "score_prompts": f"""
        WITH r AS (SELECT model_id, section, list(text ORDER BY {SOURCE_ORDER}, pos, text) AS items FROM ({TURNS}) GROUP BY ALL), m AS (SELECT DISTINCT model_id FROM r), c(section, n) AS (VALUES {prompt_head()}),
        l AS (SELECT m.model_id, c.section, n, list_transform(coalesce(items, []), lambda x: CASE WHEN contains(x, '''') AND NOT contains(x, '"') THEN length({REPR}) + 2 ELSE length(replace({REPR}, '''', chr(92) || '''')) + 2 END) AS k FROM m CROSS JOIN c LEFT JOIN r ON r.model_id = m.model_id AND r.section = c.section)
        SELECT model_id, section, CAST(n + 2 + coalesce(list_sum(k), 0) + 2 * greatest(len(k) - 1, 0) AS BIGINT) AS n_chars FROM l""",
    "llm_output_parse": "SELECT doc_id AS model_id, 'Training' AS section, doc_id % 22 + 1 AS point_number, 0.5 AS score FROM documents",
    "keyed_cache_join": f"""
        WITH p AS (SELECT {normalised('url')} AS link, page_id, length(html) AS n FROM pages), b AS (SELECT link, max(page_id) AS page_row, arg_max(n, page_id) AS page FROM p WHERE link <> '' GROUP BY link),
        c AS (SELECT trim(source) AS model_id, max(doc_id) AS card_row, arg_max(n_chars, doc_id) AS card FROM documents GROUP BY ALL), w AS (SELECT page_id, {normalised('url')} AS link, 'src' || (page_id % 25) AS model_id FROM pages)
        SELECT page_id, link, model_id, page_row, page, card_row, card FROM w LEFT JOIN b USING (link) LEFT JOIN c USING (model_id)""",
    "card_list": """
        WITH l AS (SELECT 'Org/' || source || '-' || (doc_id % 50) AS model_id, lang AS task, doc_id AS row_id FROM documents), s AS (SELECT model_id, CAST(max(quality) AS DOUBLE) AS score FROM labels JOIN l ON row_id = doc_id GROUP BY ALL),
        f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY row_id) = 1)
        SELECT model_id, task, score, row_id FROM f LEFT JOIN s USING (model_id)""",
    "report_view": "SELECT source AS model_id, CAST(arg_max(n_chars % 23, doc_id) AS DOUBLE) AS score, CAST(max(doc_id) % 7 AS DOUBLE) AS training, true AS success FROM documents WHERE trim(source) <> '' GROUP BY source",
    "placeholder_canonical": f"""
        WITH {ENTRIES}, s AS (SELECT model_id, CASE WHEN pos % 3 = 2 THEN 'paper' ELSE 'model_card' END AS source, '[' || pos || ':LINK]' AS token, pos, value FROM e),
        f AS (SELECT *, min(pos) OVER (PARTITION BY model_id, source, value) AS first FROM s)
        SELECT model_id, source, token, '[' || CASE source WHEN 'paper' THEN 'RP' ELSE 'MC' END || '_' || (dense_rank() OVER (PARTITION BY model_id, source ORDER BY first) - 1) || ':LINK]' AS canonical, value FROM f""",
    "placeholder_apply": f"SELECT doc_id, md5(card) AS digest, CAST(len({find_all('card', T.BARE_URL)}) AS BIGINT) AS n_named FROM ({CARD})",
    "payload_json": """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events""",
    "parse_cells": """
        WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['a', 'b' || doc_id] WHEN doc_id % 3 = 1 THEN ['a', source] WHEN doc_id % 2 = 0 THEN [] ELSE [source] END AS l FROM documents)
        SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, '|') AS items FROM c""",
    "source_lookup": """
        WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'RP' END AS x, CASE WHEN doc_id % 5 = 0 THEN ['RP', 'GH', 'MC'] WHEN doc_id % 4 = 0 THEN ['GH', 'MC', 'RP'] WHEN doc_id % 4 = 1 THEN ['RP', 'GH', 'MC'] ELSE ['MC', 'GH', 'RP'] END AS p FROM documents)
        SELECT doc_id, array_to_string(CASE WHEN x IS NULL THEN p ELSE list_prepend(x, list_filter(p, lambda v: v <> x)) END, ' ') AS priority FROM b""",
    "repository_tree": """
        WITH t AS (SELECT source AS repo, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS o, doc_id % 5 <> 0 AS blob, 'f' || doc_id AS path FROM documents), b AS (SELECT repo, o, coalesce(list_sort(list(path) FILTER (blob)), []) AS files FROM t GROUP BY ALL)
        SELECT repo, CAST(len(arg_min(files, o)) AS BIGINT) AS n, md5(array_to_string(arg_min(files, o), chr(10))) AS digest FROM b GROUP BY repo""",
    "first_links": f"""
        WITH l AS (SELECT doc_id, model_id, regexp_extract_all(card, {q(T.BARE_URL)})[1] AS link FROM ({CARD}))
        SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY doc_id) AS ordinal FROM l WHERE link IS NOT NULL""",
}

ORACLE_SQL["link_selection"] = f"""
    WITH p AS ({ORACLE_SQL['paper_rank']}), g AS ({ORACLE_SQL['github_rank']}), c AS (SELECT doc_id, arg_min(url, rank) AS primary_paper, list(url ORDER BY pos) AS urls FROM p GROUP BY doc_id),
    h AS (SELECT doc_id, max(link) FILTER (is_primary) AS primary_github FROM g GROUP BY doc_id)
    SELECT doc_id, primary_paper, primary_github, array_to_string(list_filter(urls, lambda u: u <> primary_paper), ' ') AS secondary_papers FROM c LEFT JOIN h USING (doc_id)"""

LATEX = r"'\\[a-zA-Z0-9]+'"
MERGED = rf"string_split(list_reduce(list_prepend(regexp_replace(l[1], {LATEX}, '', 'g'), l[2:]), lambda a, x: CASE WHEN regexp_matches(regexp_replace(a, '\s+$', ''), {ENDED}) THEN a || chr(1) || regexp_replace(x, {LATEX}, '', 'g') ELSE a || ' ' || x END), chr(1))"
ENGLISH_PAPER = r"(length(paper) < 50 OR coalesce(length(regexp_replace(substr(paper, 1, 5000), '[^A-Za-z]', '', 'g')) / CAST(nullif(length(regexp_replace(substr(paper, 1, 5000), '[^\p{L}]', '', 'g')), 0) AS DOUBLE), 1.0) >= 0.70)"
ORACLE_SQL["paper_levels"] = f"""
    WITH e AS (SELECT doc_id FROM ({PAPER}) WHERE {ENGLISH_PAPER}), {HEADING_LINES},
    b AS (SELECT doc_id, section_ord, heading, list({numbered('line', 'base')} ORDER BY pos) AS l FROM s WHERE NOT is_head AND doc_id IN (SELECT doc_id FROM e) GROUP BY ALL),
    m AS (SELECT *, {MERGED} AS blocks, max(CASE WHEN heading = 'introduction' THEN section_ord END) OVER (PARTITION BY doc_id) AS start FROM b),
    w AS (SELECT doc_id, blocks, list_filter(blocks, lambda z: NOT {table_row('z')}) AS solid FROM m WHERE (start IS NULL OR section_ord > start) AND NOT ({UNWANTED})),
    x AS (SELECT doc_id, 'section' AS level, array_to_string(solid, ' ') AS text FROM w WHERE len(solid) > 0
        UNION ALL SELECT doc_id, 'paragraph', unnest(list_filter(solid, lambda z: {words('z')} > 3)) FROM w
        UNION ALL SELECT doc_id, 'sentence', unnest(flatten(list_transform(blocks, lambda z: {kept_sentences('z')}))) FROM w),
    c AS (SELECT doc_id, level, {cleaned('text')} AS t FROM x)
    SELECT doc_id, level, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM c WHERE t <> '' AND NOT {bibliography('t')} GROUP BY ALL"""

#: Columns that DuckDB types more widely than Spark.
NARROWED = {
    "heading_sections": {"section_ord": "INTEGER"}, "section_filter": {"section_ord": "INTEGER"}, "arxiv_ids": {"pos": "INTEGER"}, "github_links": {"pos": "INTEGER"}, "other_papers": {"pos": "INTEGER"},
    "paper_rank": {"pos": "INTEGER", "rank": "INTEGER"}, "github_rank": {"pos": "INTEGER"}, "keyword_classify": {"pos": "INTEGER"}, "label_centroids": {"pos": "INTEGER"},
    "rule_tuning": {"threshold": "DOUBLE"}, "llm_output_parse": {"point_number": "INTEGER", "score": "DOUBLE"}, "keyed_cache_join": {"page": "INTEGER"}, "first_links": {"ordinal": "INTEGER"},
}
_TUNING = ORACLE_SQL["rule_tuning"].rpartition("SELECT part, count(*) AS rows")
ORACLE_SQL["tuning_status"] = f"""{_TUNING[0]}
        SELECT true AS tuned, 'validation_test_split' AS method, round(any_value(threshold), 3) AS threshold, max(rows) FILTER (part = 'validation') AS rows_validation, max(rows) FILTER (part = 'test') AS rows_test,
            {', '.join(f"max({c}) FILTER (part = '{p}') AS {c}_{p}" for c in ('baseline', 'tuned') for p in ('validation', 'test'))},
            (SELECT coalesce(string_agg(label1 || '>' || label2, ' ' ORDER BY label1, label2), '') FROM good) AS beneficial_pairs
        FROM ({_TUNING[1]}{_TUNING[2]})"""
NARROWED["tuning_status"] = {"threshold": "DOUBLE"}
for _name, _columns in NARROWED.items():
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _columns.items())}) FROM ({ORACLE_SQL[_name]})"
