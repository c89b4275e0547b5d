"""Saved pages: one pass of the standard parser gives a page's nodes in document order; rules pick what they need from them, and all that
follows is columns. A page is never split over rows, so none of this shuffles."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Elements that have no content.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements whose content is no markup, in any version of the parser.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
# Fixed value: how many pages of a batch are texts of Python at a time.
AT_ONCE = 1024
#: An end or a start with quoted attributes, between < and >: what any parser reads alike.
TAG = re.compile(r'''(/)?([a-zA-Z][a-zA-Z0-9]*)((?(1)|(?:[ \n\t]+[a-zA-Z][a-zA-Z0-9_-]*="[^"]*")*))''')
ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
# Fixed value: tags up to this length are remembered.
SHORT = 200


class Node:
    """tag: "#text" for text. at: its place; till: the place behind its last descendant."""

    __slots__ = ("page", "at", "tag", "attrs", "classes", "till", "own")

    def __init__(self, page: list[Node], at: int, tag: str, attrs: dict[str, str | None], classes: list[str], till: int = 0, own: str = ""):
        self.page, self.at, self.tag, self.attrs, self.classes, self.till, self.own = page, at, tag, attrs, classes, till, own

    def all(self, *tags: str, having: str = "", part: str = "") -> list[Node]:
        """Descendants with one of the tags (none: any), with this class, and with this in their classes."""
        found = self.page[self.at + 1 : self.till]
        if tags:
            found = [x for x in found if x.tag in tags]
        if having:
            found = [x for x in found if having in x.classes]
        return [x for x in found if part in " ".join(x.classes)] if part else found

    def first(self, *tags: str, having: str = "", part: str = "") -> Node | None:
        return next(iter(self.all(*tags, having=having, part=part)), None)

    def text(self, between: str = "") -> str:
        return between.join([x.own for x in self.page[self.at + 1 : self.till] if x.tag == "#text"])


class _Nodes:
    """The nodes that starts, ends and texts make, by the names under which the parser tells them."""

    def __init__(self):
        self.found: list[Node] = []
        self.open: list[Node] = []
        self.handle_starttag("#page", [])

    def handle_starttag(self, tag, attrs):
        at, attrs = len(self.found), dict(attrs)
        node = Node(self.found, at, tag, attrs, (attrs.get("class") or "").split(), at + 1)
        self.found.append(node)
        if tag not in EMPTY:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(x.tag == tag for x in self.open):  # an end without its start is passed by; what wasn't ended ends here
            while True:
                x = self.open.pop()
                x.till = len(self.found)
                if x.tag == tag:
                    break

    def handle_data(self, data):
        data = data.strip()
        if data:
            self.found.append(Node(self.found, len(self.found), "#text", {}, [], own=data))


class _Parser(_Nodes, HTMLParser):
    def __init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        _Nodes.__init__(self)


def _tag(text: str) -> tuple[str, str, dict[str, str | None], list[str]] | None:
    """Whether what stands between < and > is an end, its tag, attributes and classes; nodes of equal tags share them. Null: not plain."""
    m = TAG.fullmatch(text)
    if not m or m[2].lower() in RAW:
        return None
    attrs = {k.lower(): unescape(v) for k, v in ATTRIBUTE.findall(m[3])}
    return m[1] or "", m[2].lower(), attrs, (attrs.get("class") or "").split()


_known_tag = functools.lru_cache(1 << 13)(_tag)


def _read_plain(html: str) -> _Nodes | None:
    """The nodes of a page that consists of plain tags and texts, as the parser gives them, which takes several times as long; null for
    others."""
    nodes = _Nodes()
    found, open_ = nodes.found, nodes.open
    first, *rest = html.split("<")
    nodes.handle_data(unescape(first))
    for piece in rest:
        inside, closed, text = piece.partition(">")
        known = _known_tag(inside) if len(inside) <= SHORT else _tag(inside)
        if not (known and closed):
            return None
        end, tag, attrs, classes = known
        if not end:
            at = len(found)
            node = Node(found, at, tag, attrs, classes, at + 1)
            found.append(node)
            if tag not in EMPTY:
                open_.append(node)
        elif open_[-1].tag == tag:
            open_.pop().till = len(found)
        else:
            nodes.handle_endtag(tag)
        if text:
            text = (unescape(text) if "&" in text else text).strip()
            if text:
                found.append(Node(found, len(found), "#text", {}, [], 0, text))
    return nodes


def page_of(html: str | None) -> Node:
    """The page as a node. Null and empty pages have no descendants; a broken one has those that the parser finds."""
    nodes = _read_plain(html or "")
    if nodes is None:
        nodes = _Parser()
        nodes.feed(html)
        nodes.close()
    for x in nodes.open:
        x.till = len(nodes.found)
    return nodes.found[0]


def picked(pages: DataFrame, keys: list[str], schema: str, rule: Callable[[Node], Iterator[tuple]]) -> DataFrame:
    """keys and schema's columns: for each of pages(html, keys...) the rows that rule picks from it."""
    kinds = dict(pages.select(*keys).dtypes)
    found = to_arrow_schema(T._parse_datatype_string(schema))

    def rows_of(html: str | None) -> Iterator[tuple]:
        page = page_of(html)
        yield from rule(page)
        page.page.clear()  # nodes and their list hold each other

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p.slice(start, AT_ONCE) for p in parts for start in range(0, p.num_rows, AT_ONCE)):
            rows = [(i, r) for i, html in enumerate(part.column("html").to_pylist()) for r in rows_of(html)]
            own = part.select(keys).take(pa.array([i for i, _ in rows], pa.int64()))
            columns = zip(*(r for _, r in rows), strict=True) if rows else [()] * len(found)
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, f.type) for c, f in zip(columns, found, strict=True))], [*keys, *found.names])

    return pages.select(*keys, "html").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))
