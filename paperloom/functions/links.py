"""Link extraction and normalisation as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# --- fixed values: patterns, segments and extensions ---------------------------------------------
ARXIV_URL = r"https?://arxiv\.org/(abs|pdf)/(\d+\.\d+)"
HUB_PAPER_URL = r"https?://(?:huggingface\.co|hf\.co)/papers/(\d+\.\d+)"
URL = r"https?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9@:%_\+.~#?&//=]*)"
GITHUB = r"(?:(?:git|ssh|http(?:s)?)|(?:git@[\w\.]+))(?::(?://)?)github\.com\/(?:[\w\.@\:/\-~]+)(?:/)?"
GITHUB_SIMPLE = r"(?:https?://)?github\.com/[\w.\-]+/[\w.\-]+"
GITHUB_REPO = r"(?i)https?://github\.com/[\w.\-]+/[\w.\-]+"
TRAILING = ".,;:!?)\"'"
ASSET_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg", "bmp", "webp", "ico", "pdf", "zip", "tar", "gz", "tgz", "mp4", "mp3", "wav", "avi", "csv", "json", "jsonl", "yaml", "yml", "txt")
PAGE_SEGMENTS = ("/stargazers", "/issues", "/pulls", "/wiki", "/releases", "/actions", "/discussions", "/assets", "/commit", "/marketplace")
PAPER_LABEL = r"(?i)^(?:[-*+]\s+)?\[?\s*\*{0,2}(?:paper|link to (?:the )?paper)\*{0,2}\s*:"
GITHUB_LABEL = (
    r"(?i)(?:\[(?:github|code|repo(?:sitory)?|source(?:\s*code)?|implementation)\]"
    r"|\*{0,2}(?:github(?:\s*(?:repo(?:sitory)?|link))?|code|repo(?:sitory)?|source(?:\s*code)?|implementation)\*{0,2}\s*:"
    r"|(?:official|original)\s+(?:code|implementation|repo(?:sitory)?)"
    r"|(?:code|source(?:\s*code)?)\s+(?:is\s+)?(?:available|released)\s+(?:at|on|in))"
)
ARXIV_ID = r"(\d{4}\.\d{4,5})"
BIBTEX_BLOCK = r"(?s)@\w+\{.*?\n\s*\}"
TOKEN = r"\d+[a-zA-Z]+(?:[\d.]*)|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+(?:[\d.]*)|[A-Z]+(?:[\d.]*)|\d+"
NULL_NAMES = ("nan", "none", "null")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def arxiv_ids(text: Column) -> Column:
    """Identifiers in archive addresses, then those in hub paper addresses."""
    return F.concat(find_all(text, ARXIV_URL, 2), find_all(text, HUB_PAPER_URL, 1))


def arxiv_pdf_url(arxiv_id: Column) -> Column:
    """S5."""
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id, F.lit(".pdf"))


def ordered_union(a: Column, b: Column) -> Column:
    """The first of each value, in order."""
    return F.array_distinct(F.concat(a, b))


def other_paper_urls(text: Column) -> Column:
    """Array of (id, url) of papers that two other libraries hold; repeats are kept."""
    urls = F.transform(find_all(text, URL), lambda u: F.rtrim(u, F.lit("/")))
    anthology, cvf = (lambda u: F.contains(u, F.lit("anthology.org"))), (lambda u: F.contains(u, F.lit("openaccess.thecvf.com")))
    pdf = lambda u: F.when(anthology(u), F.when(u.endswith(".pdf"), u).otherwise(F.concat(u, F.lit(".pdf")))).otherwise(F.replace(F.replace(u, F.lit("/html/"), F.lit("/papers/")), F.lit(".html"), F.lit(".pdf")))
    return F.transform(F.filter(urls, lambda u: anthology(u) | cvf(u)), lambda u: F.struct(u.alias("id"), pdf(u).alias("url")))


def strip_trailing(link: Column) -> Column:
    return F.rtrim(link, F.lit(TRAILING))


def cut_at_first(link: Column, segments: tuple[str, ...]) -> Column:
    """The link up to the first of ``segments``, tried in order, that occurs in it in any case."""
    low = F.lower(F.rtrim(link, F.lit("/")))
    out = F.when(F.lit(False), link)
    for s in segments:
        out = out.when(F.locate(s, low) > 0, F.substring(link, F.lit(1), F.locate(s, low) - 1))
    return out.otherwise(link)


def github_links(text: Column) -> Column:
    """X5 with F12 and F13: repository links in text order, repeats kept."""
    links = F.transform(find_all(text, GITHUB), strip_trailing)
    asset = r"\.(" + "|".join(ASSET_EXTENSIONS) + ")$"
    links = F.filter(links, lambda x: ~F.lower(F.rtrim(x, F.lit("/"))).rlike(asset))
    links = F.transform(links, lambda x: cut_at_first(cut_at_first(x, ("/blob/", "/raw/")), PAGE_SEGMENTS))
    path = lambda x: F.trim(F.regexp_replace(F.lower(F.rtrim(x, F.lit("/"))), r"https?://github\.com/?", ""), F.lit("/"))
    return F.filter(links, lambda x: F.contains(path(x), F.lit("/")))


def abstract_github_links(text: Column) -> Column:
    """Links with or without a scheme."""
    return F.transform(find_all(text, GITHUB_SIMPLE), strip_trailing)


def labelled_paper_refs(text: Column) -> Column:
    """Distinct identifiers and other addresses on lines labelled as the paper."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x).rlike(PAPER_LABEL))
    urls = lambda x: F.filter(F.transform(find_all(x, URL), lambda u: F.rtrim(u, F.lit("/"))), lambda u: ~F.contains(F.lower(u), F.lit("arxiv.org")))
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.concat(find_all(x, ARXIV_ID, 1), urls(x)))))


def labelled_repos(text: Column) -> Column:
    """Distinct lower-case org/repo on lines with a repository label."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(GITHUB_LABEL))
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.transform(find_all(x, GITHUB_REPO), lambda u: F.regexp_replace(F.lower(u), "^https?://github\\.com/", "")))))


def github_path(link: Column) -> Column:
    """Lower-case path after the host, outer slashes gone."""
    return F.trim(F.lower(F.regexp_replace(link, "https?://github\\.com/", "")), F.lit("/"))


def repo_of(link: Column) -> Column:
    """org/repo, or null for a shorter path."""
    parts = F.split(github_path(link), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def repo_and_extra(link: Column) -> Column:
    """org/repo and what follows it, without a branch's tree, blob or raw segments."""
    parts = F.split(github_path(link), "/")
    extra = F.slice(parts, 3, 1000)
    extra = F.when(F.get(extra, F.lit(0)).isin("tree", "blob", "raw"), F.slice(extra, 3, 1000)).otherwise(extra)
    repo = F.coalesce(repo_of(link), F.lower(F.regexp_replace(link, "https?://github\\.com/", "")))
    return F.when(F.size(extra) > 0, F.concat_ws("/", repo, F.array_join(extra, "/"))).otherwise(repo)


def tokens(text: Column) -> Column:
    """X11: runs of letters and digits of an identifier; a segment without one stands for itself."""
    found = F.transform(F.split(text, "[-_./]"), lambda s: F.struct(s.alias("s"), find_all(s, TOKEN).alias("t")))
    return F.transform(F.flatten(F.transform(found, lambda x: F.when(F.size(x["t"]) > 0, x["t"]).otherwise(F.array(x["s"])))), F.lower)


def token_set(text: Column) -> Column:
    """Distinct words of letters, digits and hyphens, lower-case."""
    return F.array_distinct(find_all(F.lower(text), r"[a-zA-Z0-9\-]+"))


def github_parts(url: Column) -> Column:
    """Struct of owner, repo and sub_path; empty strings and null where missing."""
    path = F.trim(F.regexp_replace(F.regexp_replace(url, r"\.git$", ""), r"^(?:https?://)?(?:www\.)?github\.com/", ""), F.lit("/"))
    parts = F.split(path, "/")
    deep = F.get(parts, F.lit(2)).isin("blob", "tree") & (F.size(parts) > 4)
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("owner"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("repo"),
        F.when(deep, F.array_join(F.slice(parts, 5, 1000), "/")).alias("sub_path"),
    )


def normalise_link(url: Column) -> Column:
    """Fragment, query, scheme, closing slashes, .git and .pdf are evened out; case last."""
    s = F.trim(F.coalesce(url, F.lit("")))
    out = F.rtrim(F.replace(F.substring_index(F.substring_index(s, "#", 1), "?", 1), F.lit("http://"), F.lit("https://")), F.lit("/"))
    out = F.regexp_replace(out, r"\.git$", "")
    out = F.regexp_replace(F.replace(out, F.lit("https://arxiv.org/pdf/"), F.lit("https://arxiv.org/abs/")), r"\.pdf$", "")
    return F.when(F.lower(s).isin("", *NULL_NAMES), F.lit("")).otherwise(F.lower(out))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
