"""Inline Markdown: each rule by literal cases."""

import pytest

from paperloom.functions.inline import inline_tree, take_definitions
from paperloom.functions.markup import markdown_parts


def shape(nodes):
    """A tree in short: text as it is, emphasis in braces, code in ticks, links as text@address, images as !address."""
    kinds = {"text": lambda n: n.text, "code": lambda n: f"`{n.text}`", "emphasis": lambda n: f"{{{n.text} {shape(n.inside)}}}", "link": lambda n: f"<{shape(n.inside)}@{n.text}>", "image": lambda n: f"<!{n.text}>"}
    return "".join(kinds[n.kind](n) for n in nodes)


DEFINED = {"r": "https://e.org/r", "two words": "u"}
CASES = {
    "a *b* c": "a {* b} c", "a **b *c* d**": "a {** b {* c} d}", "*a **b** c*": "{* a {** b} c}", "***a***": "{* {** a}}", "***a** b*": "{* {** a} b}", "**a*": "*{* a}", "*a **b*": "*a *{* b}",
    "2 * 3 * 4": "2 * 3 * 4", "a * b*": "a * b*", "snake_case_name": "snake_case_name", "_a_b_": "{_ a_b}", "__a _b_ c__": "{__ a {_ b} c}", "un*frigging*real": "un{* frigging}real", "*(a)*b": "*(a)*b", "(_a_)": "({_ a})",
    "*a _b* c_": "{* a _b} c_", "**a _b_": "**a {_ b}", "~~a~~": "~~a~~", "**": "**", "a*": "a*", "*foo**bar*": "{* foo**bar}",
    r"\*a\* \[b\](c)": "*a* [b](c)", "`a *b* [c](d)`": "`a *b* [c](d)`", "``a ` b``": "`a ` b`", "`a": "`a", "*a `b* c`": "*a `b* c`",
    "[a](b)": "<a@b>", "[a *b `c`*](d)": "<a {* b `c`}@d>", "[a](<b c> 't')": "<a@b c>", '[a](b "t")': "<a@b>", "[a](b(c)d)": "<a@b(c)d>", "[a](b c)": "[a](b c)", "[a]": "[a]", "a ] b [": "a ] b [", "[a](": "[a](", "[]()": "<@>",
    "[a [b](c) d](e)": "[a <b@c> d](e)", "[![a](b)](c)": "<<!b>@c>", "![a [b](c)](d)": "<!d>", "[a *b](c) d*": "<a *b@c> d*", "*[a](b)*": "{* <a@b>}",
    "[x][r]": "<x@https://e.org/r>", "[r]": "<r@https://e.org/r>", "[R][]": "<R@https://e.org/r>", "[a][none]": "[a][none]", "[Two\nWORDS]": "<Two\nWORDS@u>", "[x *y*][r] [q]": "<x {* y}@https://e.org/r> [q]", "![x][r]": "<!https://e.org/r>", "[a [r] b][r]": "[a <r@https://e.org/r> b]<r@https://e.org/r>",
    "<https://a.b/c>": "<https://a.b/c@https://a.b/c>", "a <b>c</b> <!-- d --> e": "a c  e", "a < b > c": "a < b > c", "<a@b.c>": "",
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert shape(inline_tree(text, DEFINED)) == CASES[text]


def test_definitions_begin_a_paragraph():
    found = {}
    left = take_definitions("[A b]: <x y> 't'\n[a  B]: other\n[c]:\n  d (t)\ntext [e]: f", found)
    assert (left, found) == ("text [e]: f", {"a b": "x y", "c": "d"})
    assert take_definitions("[ ]: x", {}) == "[ ]: x" and take_definitions("[a]: b c", {}) == "[a]: b c"


def test_many_delimiters_end():
    for text in ("*a " * 3000, "[" * 3000, "a*" * 1500, "[a](" * 1000, "_a_ *b* " * 1000):
        inline_tree(text)


def test_references_are_read_wherever_they_are_defined():
    got = markdown_parts("See *the [paper][P] and* code [here] now.\n\n[p]: https://a.org/x 'T'\n[here]: mailto:a@b.org\n\nOther [text][none] stays as it was.")
    assert got["paragraphs"] == ["See the [0:LINK] and code [0:EMAIL] now.", "Other [text][none] stays as it was."]
    assert (got["links"][0], got["emails"][0]) == ("https://a.org/x", "a@b.org")
