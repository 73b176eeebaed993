"""Inline Markdown as a tree: nested emphasis by a stack of delimiters, links and references by a stack of brackets."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

#: What may not be plain text: escapes, code, addresses in angles, tags, delimiters, brackets.
_SPECIAL = re.compile(r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<tick>`+)|<(?P<auto>(?:https?://|mailto:)[^<>\s]+)>|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)|(?P<mark>\*+|_+)|(?P<open>!?\[)|(?P<close>\])", re.S)
_TARGET = re.compile(r"""\(\s*(?:<(?P<angled>[^<>\n]*)>|(?P<bare>[^\s()<]?[^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)""")
_LABEL = re.compile(r"\[(?P<label>[^\[\]]*)\]")
_DEFINITION = re.compile(r"""\A {0,3}\[(?P<label>[^\[\]]*[^\[\]\s][^\[\]]*)\]:[ \t]*\n?[ \t]*(?:<(?P<angled>[^<>\n]*)>|(?P<bare>\S+))(?:[ \t]*\n?[ \t]+(?:"[^"]*"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|\Z)""")


@dataclass
class Node:
    """``kind``: text, code, emphasis, link, image; ``text`` is a text's or code's content or a link's address."""

    kind: str
    text: str = ""
    inside: list[Node] = field(default_factory=list)


@dataclass
class _Run:
    """A run of * or _; what is left of it once emphasis is found is text."""

    mark: str
    left: int
    opens: bool
    closes: bool
    length: int


@dataclass
class _Bracket:
    at: int  # place among the items
    after: int  # place in the text, behind it
    image: bool
    live: bool = True


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


def take_definitions(paragraph: str, found: dict[str, str]) -> str:
    """A paragraph without the link definitions that it begins with; the first definition of a label counts."""
    while m := _DEFINITION.match(paragraph):
        found.setdefault(label_key(m["label"]), m["angled"] if m["angled"] is not None else m["bare"])
        paragraph = paragraph[m.end() :]
    return paragraph


def _flanks(before: str, after: str) -> tuple[bool, bool]:
    """Whether a run of delimiters between two characters has text to its right, and to its left."""
    blank = lambda c: not c or c.isspace()
    marked = lambda c: bool(c) and unicodedata.category(c)[0] in "PS"
    right = not blank(after) and (not marked(after) or blank(before) or marked(before))
    left = not blank(before) and (not marked(before) or blank(after) or marked(after))
    return right, left


def _run(text: str, start: int, end: int) -> _Run:
    before, after = text[start - 1 : start], text[end : end + 1]
    opens, closes = _flanks(before, after)
    if text[start] == "_":  # not inside a word
        opens, closes = opens and (not closes or not before.isalnum()), closes and (not opens or not after.isalnum())
    return _Run(text[start], end - start, opens, closes, end - start)


def _settle(items: list) -> list[Node]:
    """Items with their runs paired to emphasis, from the inside out; neighbouring texts are one."""
    k = 0
    while k < len(items):
        closer = items[k]
        if isinstance(closer, _Run) and closer.closes:
            j = k - 1
            while j >= 0:
                o = items[j]
                if isinstance(o, _Run) and o.opens and o.mark == closer.mark:
                    # a run that both opens and closes pairs with another only if their lengths do not add up to a multiple of three
                    if not ((o.closes or closer.opens) and (o.length + closer.length) % 3 == 0 and (o.length % 3 or closer.length % 3)):
                        break
                j -= 1
            if j >= 0:
                used = 2 if items[j].left > 1 and closer.left > 1 else 1
                items[j + 1 : k] = [Node("emphasis", items[j].mark * used, _texts(items[j + 1 : k]))]
                k = j + 2
                items[j].left -= used
                closer.left -= used
                if not items[j].left:
                    del items[j]
                    k -= 1
                if not closer.left:
                    del items[k]
                continue
        k += 1
    return _texts(items)


def _texts(items: list) -> list[Node]:
    out: list[Node] = []
    for x in items:
        node = Node("text", x.mark * x.left) if isinstance(x, _Run) else x
        if node.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", out[-1].text + node.text)
        elif node.kind != "text" or node.text:
            out.append(node)
    return out


def inline_tree(text: str, definitions: dict[str, str] | None = None) -> list[Node]:
    """Nodes of a block's text. Links hold no links; a bracket without an address or definition is text."""
    definitions = definitions or {}
    items: list = []
    brackets: list[_Bracket] = []
    at = 0
    while m := _SPECIAL.search(text, at):
        if m.start() > at:
            items.append(Node("text", text[at : m.start()]))
        at = m.end()
        if m["escape"]:
            items.append(Node("text", m["escape"][1]))
        elif m["tick"]:
            end = re.compile(rf"(?<!`){m['tick']}(?!`)").search(text, at)
            items.append(Node("code", " ".join(text[at : end.start()].split("\n")).strip()) if end else Node("text", m["tick"]))
            at = end.end() if end else at
        elif m["auto"]:
            items.append(Node("link", m["auto"], [Node("text", m["auto"])]))
        elif m["mark"]:
            items.append(_run(text, m.start(), m.end()))
        elif m["open"]:
            brackets.append(_Bracket(len(items), at, m["open"][0] == "!"))
            items.append(Node("text", m["open"]))
        elif m["close"]:
            opener = brackets.pop() if brackets else None
            address = None
            if opener and opener.live:
                if target := _TARGET.match(text, at):
                    address, end = target["angled"] if target["angled"] is not None else target["bare"], target.end()
                else:
                    label = _LABEL.match(text, at)
                    said = label["label"] if label and label["label"].strip() else text[opener.after : m.start()]
                    address, end = definitions.get(label_key(said)), label.end() if label else at
            if address is None:
                items.append(Node("text", "]"))
                continue
            inside = _settle(items[opener.at + 1 :])
            items[opener.at :] = [Node("image" if opener.image else "link", address, inside)]
            at = end
            if not opener.image:
                for b in brackets:
                    b.live = b.live and b.image
    if at < len(text):
        items.append(Node("text", text[at:]))
    return _settle(items)
