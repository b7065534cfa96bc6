"""Markup of dictionary entries and books made plain.

An entry is read once, as a run of texts and tags. A table says by a tag's name what becomes of it;
what both uses have in common is in one table and what differs in a second. Texts go through
unchanged but for white space, so the order of rules can't matter."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_PIECE = re.compile(r"""<(?P<declaration>[?!][^>]*)>|<(?P<closing>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)>|(?P<text>[^<]+|<)""")
_ATTRIBUTE = re.compile(r"""\s+([\w:.-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# What becomes of a tag. keep: as it is; open: the tag goes, what it holds stays;
# gone: it goes with what it holds; rule: its end becomes a rule; word: an empty tag becomes its value.
_BOTH = {"idx:entry": "open", "idx:orth": "open", "idx:short": "open", "idx:iform": "open", "idx:infl": "gone"}
_LISTED = {**_BOTH, "idx:orth": "word", "mbp:pagebreak": "open", "mbp:frameset": "open"}
_INDEXED = {**_BOTH, "idx:entry": "rule", "html": "open", "body": "open"}
RULE = "<hr/>"


class Piece(NamedTuple):
    """A text (no name) or a tag; empty tells a tag that closes itself."""

    source: str
    name: str = ""
    closing: bool = False
    empty: bool = False
    rest: str = ""


def pieces(source: str) -> Iterator[Piece]:
    """Texts and tags in turn; declarations are left out."""
    for m in _PIECE.finditer(source):
        if m["text"] is not None:
            yield Piece(m[0])
        elif m["name"]:
            rest = m["rest"].rstrip()
            yield Piece(m[0], m["name"].lower(), bool(m["closing"]), rest.endswith("/"), rest.rstrip("/"))


def attributes(rest: str) -> list[tuple[str, str]]:
    return [(m[1], (m[2] or "").strip("\"'") if m[2] and m[2][0] in "\"'" else m[2] or "") for m in _ATTRIBUTE.finditer(rest)]


def _acted(source: str, table: dict[str, str]) -> Iterator[Piece]:
    """The pieces that the table leaves; an element that goes takes the white space behind it along."""
    inside, trim = "", False
    for p in pieces(source):
        action = table.get(p.name, "keep")
        if inside:
            if p.closing and p.name == inside:
                inside, trim = "", True
        elif not p.name:
            text = p.source.lstrip() if trim else p.source
            trim = trim and not text
            if text:
                yield Piece(text)
        elif action == "gone" and not p.closing:
            inside, trim = ("", True) if p.empty else (p.name, trim)
        elif action == "word" and p.empty and (value := dict(attributes(p.rest)).get("value")) is not None:
            trim = False
            yield from (Piece("<b>", "b"), Piece(value), Piece("</b>", "b", True))
        elif action == "rule" and p.closing:
            trim = False
            yield Piece(RULE, "hr", False, True)
        elif action == "keep":
            trim = False
            yield p
        else:
            trim = trim or p.name in ("idx:entry", "idx:iform") and not p.closing


_WORD_LINK = re.compile(r"(?:content_\d+\.html)?#hw_(.+)", re.S)


def _to_word(p: Piece) -> str:
    """A tag whose link to a headword's place names the word."""
    for name, value in attributes(p.rest) if p.name and "#hw_" in p.rest else ():
        found = _WORD_LINK.fullmatch(value)
        if name == "href" and found:
            return re.sub(r"""href\s*=\s*("[^"]*"|'[^']*')""", lambda _: f'href="bword://{found[1]}"', p.source, count=1)
    return p.source


def listed(source: str, headword: str) -> str:
    """An entry for a word list: forms go, a headword's tag becomes bold, links name their words.

    If nothing is left it is the headword, escaped, in bold."""
    out = "".join(map(_to_word, _acted(source, _LISTED))).strip()
    lines = [x for k, x in enumerate(out.split("\n")) if x.strip() or not k]
    return "\n".join(lines) or f"<b>{entities.escape(headword)}</b>"


def _bare(p: Piece) -> str:
    """A tag without name spaces, classes and styles."""
    if p.closing or not p.rest:
        return p.source
    kept = _ATTRIBUTE.sub(lambda m: "" if m[1] in ("class", "style") or m[1].startswith("xmlns:") else m[0], p.rest)
    return p.source if kept == p.rest else f"<{p.source[1 : 1 + len(p.name)]}{kept}{'/' * p.empty}>"


def _spaced(before: Piece, after: Piece) -> bool:
    """Whether a space stands between two tags: behind bold and big words, between a paragraph and a
    rule, and between an empty tag and a bold or big word."""
    if before.closing and before.name in ("b", "big") or before.closing and before.name == "p" and after.name == "hr":
        return True
    return before.empty and after.name in ("b", "big") and not after.closing


def indexed(source: str) -> str:
    """The text that an index points into: no name spaces, classes, styles or form data; an entry ends in a rule.

    A head keeps its style elements and gets an empty guide. Items of ordered lists are numbered.
    White space is one space, and between tags it goes but where _spaced wants it."""
    out: list[Piece] = []
    head: list[str] | None = None
    style = False
    for p in _acted(source, _INDEXED):
        if head is not None:
            style = (style or p.name == "style") and not (p.name == "head")
            if style and p.name != "head":
                head.append(p.source)
            if p.name == "style" and p.closing:
                style = False
            if p.name == "head" and p.closing:
                out.append(Piece(f"<head>{''.join(head)}<guide></guide></head>", "head", True))
                head = None
        elif p.name == "head" and not p.closing and not p.empty:
            head = []
        else:
            out.append(p)
    made, last = [], None
    numbers = _Numbers()
    for p in out:
        if not p.name:
            text = re.sub(r"\s+", " ", p.source)
            if text != " " or last is None or not last.name:
                made.append(text)
                last = p
            elif last.name:
                continue
            continue
        if last is not None and last.name and _spaced(last, p):
            made.append(" ")
        made.append(re.sub(r"\s+", " ", p.source if p.name == "head" else numbers.numbered(p._replace(source=_bare(p)))))
        last = p
    return "".join(made).strip()


class _Numbers:
    """The numbers of list items; a nested list begins at 1, a given value goes on from there."""

    def __init__(self):
        self.lists: list[list] = []

    def numbered(self, p: Piece) -> str:
        if p.name in ("ol", "ul"):
            if not p.closing:
                self.lists.append([p.name, 0])
            elif self.lists:
                self.lists.pop()
        elif p.name == "li" and not p.closing and self.lists and self.lists[-1][0] == "ol":
            given = re.match(r"\d+", dict(attributes(p.rest)).get("value", ""))
            self.lists[-1][1] = int(given[0]) if given else self.lists[-1][1] + 1
            if not given:
                return f'{p.source[:-1].rstrip("/")} value="{self.lists[-1][1]}">'
        return p.source


def numbered(source: str) -> str:
    """Items of ordered lists with their numbers."""
    numbers, out = _Numbers(), []
    for m in _PIECE.finditer(source):
        rest = (m["rest"] or "").rstrip()
        out.append(numbers.numbered(Piece(m[0], m["name"].lower(), bool(m["closing"]), rest.endswith("/"), rest.rstrip("/"))) if m["name"] else m[0])
    return "".join(out)


@pandas_udf(StringType())
def plain_entry(html: pd.Series, headword: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else listed(x, w or "") for x, w in zip(html, headword)], dtype=object)


@pandas_udf(StringType())
def index_text(html: pd.Series) -> pd.Series:
    return html.map(indexed, na_action="ignore")


def book_text(html: Column) -> Column:
    """Without declarations of prefixed name spaces."""
    return F.regexp_replace(html, r"""\s+xmlns:[\w.-]+\s*=\s*("[^"]*"|'[^']*')""", "")


@pandas_udf(StringType())
def numbered_lists(x: pd.Series) -> pd.Series:
    return x.map(numbered, na_action="ignore")


def escaped_rules_last(css: Column) -> Column:
    """Rules whose selector escapes a colon come after the others; both keep their order."""
    rules = F.regexp_extract_all(css, F.lit(r"(?s)[^{}]*\{[^{}]*\}"), F.lit(0))
    late = lambda r: F.contains(F.substring_index(r, "{", 1), F.lit("\\:"))
    moved = F.concat(F.filter(rules, lambda r: ~late(r)), F.filter(rules, late))
    return F.when(F.exists(rules, late), F.array_join(F.transform(moved, lambda r: F.trim(r)), "\n")).otherwise(css)
