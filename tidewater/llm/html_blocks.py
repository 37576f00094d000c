"""Leaf blocks of an HTML page: runs of text with the tags, classes and ids around them.

A small tolerant reader: it closes paragraphs, items and cells where HTML lets
them be left open, ignores end tags that close nothing, skips scripts, styles,
comments and titles, ends the head at the first tag that can't be in it, and drops a
tag that the end of the page cuts off.  Elements with the attribute ``hidden`` or with
``aria-hidden="true"`` have no text, the page's own ``html`` and ``body`` excepted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

_NAME = re.compile("(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag as most are, with quoted values and no bracket in them; an attempt ends at the next bracket.  All others are scanned.
_COMMON = re.compile(
    r"""(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^=<>]*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'))*+[^=<>]*+)>"""
)
_SPECIAL, _BRACKET, _BLANK = re.compile("[=>]"), re.compile("[<>]"), re.compile(r"\s*")
#: Elements whose content is no text.  One of the second kind that is left open is taken for any other element.
_RAW, _ASIDE = frozenset("script style iframe title textarea".split()), frozenset("template svg noscript select".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW | _ASIDE}
#: Of these, what can't be inside, so that an end tag behind it belongs to another one.
_NOT_IN = {
    "svg": re.compile(r"<(?:body|article|section|main|h[1-6]|p|div|table|ul|ol)(?=[\s/>])", re.I),
    "select": re.compile(r"<(?:select|body|article|section|main|h[1-6]|p|div|table|ul|ol)(?=[\s/>])", re.I),
    "noscript": re.compile(r"<(?:noscript|body)(?=[\s/>])", re.I), "template": re.compile(r"<body(?=[\s/>])", re.I),
}
#: Tags that leave a head open.
_IN_HEAD = frozenset("head base link meta".split())
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?<![^\s\"'/])hidden(?![^\s=/])(?!\s*=\s*[\"']?until-found)|(?<![^\s\"'/])aria-hidden\s*=\s*[\"']?true(?![^\s\"'/])", re.I)
#: Tags that neither begin nor end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr input".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of these, unless one of the bounds comes before.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}),
}
_IN_P = frozenset(
    "p div ul ol dl table h1 h2 h3 h4 h5 h6 article section nav header footer aside main form blockquote pre figure hr address fieldset".split()
)


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]  # from the root to the block
    words: frozenset[str]  # of class, id and role attributes of these
    near: frozenset[str]  # of the innermost of them that has any
    link_chars: int
    parent: int  # number of the element that the block is in


class _Open(NamedTuple):
    tag: str
    words: frozenset[str]
    near: frozenset[str]
    number: int
    hidden: bool


_ROOT = _Open("", frozenset(), frozenset(), 0, False)


class _Token(NamedTuple):
    start: int
    end: int
    skipped: str | None  # the element that was skipped with all its content
    ends: str
    tag: str | None
    attributes: str


class _Reader:
    """Tags, comments and skipped elements of a page, each place of which is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.gone, self.last, self.dead = page, {}, (0, -1), set()

    def _find(self, what: str, at: int, search) -> int:
        """``search(at)``, or -1 without a search once there was none from an earlier place."""
        if at >= self.gone.get(what, len(self.page) + 1):
            return -1
        found = search(at)
        if found < 0:
            self.gone[what] = at
        return found

    def _special(self, at: int) -> int:
        low, found = self.last
        if not low <= at <= found:
            m = _SPECIAL.search(self.page, at)
            self.last = (at, found := m.start() if m else len(self.page))
        return found

    def _close(self, at: int) -> int:
        """The place of the bracket that ends a tag; -1 without one.  A quote only counts after an equals sign."""
        page, seen = self.page, []
        while (k := self._special(at)) < len(page) and k not in self.dead:
            if page[k] == ">":
                return k
            seen.append(k)
            at = k + 1
            quote = _BLANK.match(page, at).end()
            if page[quote : quote + 1] in ('"', "'"):
                closing = self._find(page[quote], quote + 1, lambda a, q=page[quote]: page.find(q, a))
                at = closing + 1 if closing >= 0 else at
        self.dead.update(seen)  # from none of these a tag ends
        return -1

    def _end_of(self, tag: str, at: int) -> int:
        """Where the content of an element that is skipped ends, with its end tag; -1 if it was left open."""
        found = self._find("</" + tag, at, lambda a: m.start() if (m := _END[tag].search(self.page, a)) else -1)
        if found >= 0 and tag in _NOT_IN:
            if tag == "svg" and "foreignobject" in self.page[at:found].lower():
                return _END[tag].match(self.page, found).end()
            inner = self._find("in " + tag, at, lambda a: m.start() if (m := _NOT_IN[tag].search(self.page, a)) else -1)
            if 0 <= inner < found:
                return -1
        return _END[tag].match(self.page, found).end() if found >= 0 else -1

    def tokens(self) -> Iterator[_Token]:
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith(("!", "?"), at):
                comment = page.startswith("!--", at)
                # The shortest comments are <!--> and <!--->.
                k = self._find("-->" if comment else ">", start + 2 if comment else at, lambda a, q="-->" if comment else ">": page.find(q, a))
                at = len(page) if k < 0 else k + (3 if comment else 1)
                yield _Token(start, at, None, "", None, "")
                continue
            m = _COMMON.match(page, at)
            if m:
                k = m.end() - 1
            else:
                m = _NAME.match(page, at)
                if not m:
                    continue
                k = self._close(m.end())
                if k < 0:
                    b = _BRACKET.search(page, m.end())
                    if b and b[0] == "<":
                        continue
                    if not b:
                        yield _Token(start, len(page), None, "", None, "")
                        return
                    k = b.start()
            at, tag = k + 1, m[2].lower()
            if not m[1] and tag in _END:
                end = self._end_of(tag, at)
                if end >= 0 or tag in _RAW:
                    at = end if end >= 0 else len(page)
                    yield _Token(start, at, tag, "", None, "")
                    continue
            yield _Token(start, at, None, m[1], tag, page[m.end(2) : k])


def blocks(page: str | None) -> list[Block]:
    """All blocks of a page that have text, in order; none for null or without text."""
    out: list[Block] = []
    page = page or ""
    stack: list[_Open] = []
    parts: list[str] = []
    links = link_chars = number = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else _ROOT
                tags = tuple(e.tag for e in stack if e.tag not in INLINE)
                out.append(Block(text, tags, top.words, top.near, min(link_chars, len(text)), _holder(stack)))
            parts.clear()
        link_chars = 0

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            links -= e.tag == "a"
        del stack[k:]

    def last(tags: set[str], bounds: set[str]) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in bounds:
                break
        return -1

    at = 0
    for token in _Reader(page).tokens():
        if token.start > at and not (stack and stack[-1].hidden):
            piece = page[at : token.start]
            parts.append(piece)
            if links:
                link_chars += len(piece.strip())
        at = token.end
        ends, tag, attributes = token.ends, token.tag, token.attributes
        if tag is None:
            if token.skipped:
                if token.skipped not in ("template", "svg", "noscript", "iframe", "textarea", "select"):
                    flush()
                else:
                    parts.append(" ")
            continue
        if stack and stack[-1].tag == "head" and not ends and tag not in _IN_HEAD:
            flush()
            close(len(stack) - 1)
        if tag == "br":
            parts.append(" ")
            continue
        if ends:
            k = last({tag}, set())
            if k >= 0 or tag not in INLINE:
                if tag not in INLINE:
                    flush()
                if k >= 0:
                    close(k)
            continue
        if tag not in INLINE:
            flush()
            if tag in _IN_P and (k := last({"p"}, {"td", "th", "li", "div", "article", "section", "body"})) >= 0:
                close(k)
            if tag in _CLOSES and (k := last(*_CLOSES[tag])) >= 0:
                close(k)
        if tag in _VOID or attributes.endswith("/"):
            continue
        number += 1
        top = stack[-1] if stack else _ROOT
        named = frozenset(w.lower() for g in _NAMED.findall(attributes) for w in _WORD.findall(" ".join(g))) if "=" in attributes else None
        hidden = top.hidden or tag not in ("html", "body") and _is_hidden(attributes)
        words, near = (top.words | named, named) if named else (top.words, top.near)
        stack.append(_Open(tag, words, near, number, hidden))
        links += tag == "a"
    tail = page[at:]
    if tail and not (stack and stack[-1].hidden):
        parts.append(tail)
    flush()
    return out


def _is_hidden(attributes: str) -> bool:
    if "hidden" not in attributes.lower():
        return False
    values = _VALUE.sub(lambda m: m[0] if len(m[0]) < 20 and m[0].strip("= \t\n\"'").lower() in ("true", "until-found") else "=x ", attributes)
    return bool(_HIDDEN.search(values))


def _holder(stack: list[_Open]) -> int:
    """The element around the innermost block element, so that paragraphs of one parent share it."""
    numbers = [e.number for e in stack if e.tag not in INLINE]
    return numbers[-2] if len(numbers) > 1 else 0
