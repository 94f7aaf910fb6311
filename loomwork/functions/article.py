"""Title and text of a news page by known places, in Arrow batches.

Pages are trees that no Column expression can walk, so this one runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .dictionaries import BODY_PLACES, PAGE_FRAME, PAGE_JUNK, PAGE_NOT_TEXT, TITLE_PLACES

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_JUNK = re.compile(PAGE_JUNK, re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node | str]:
        """All below, in page order, without recursion."""
        left = self.children[::-1]
        while left:
            x = left.pop()
            yield x
            if isinstance(x, Node):
                left.extend(x.children[::-1])

    def junk(self) -> bool:
        return self.tag in PAGE_FRAME or any(_JUNK.search(self.attrs.get(a, "")) for a in ("class", "id"))

    def texts(self, skip: frozenset[str] = frozenset()) -> list[str]:
        out, left = [], self.children[::-1]
        while left:
            x = left.pop()
            if isinstance(x, str):
                if s := x.strip():
                    out.append(s)
            elif x.tag not in skip:
                left.extend(x.children[::-1])
        return out


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    left = [tree.root]
    while left:  # frames and menus go, with all they hold
        node = left.pop()
        node.children = [x for x in node.children if isinstance(x, str) or not x.junk()]
        left += [x for x in node.children if isinstance(x, Node)]
    return tree.root


def _at(root: Node, tag: str, attr: str, value: str, pattern: bool) -> Node | None:
    def fits(x: Node) -> bool:
        if not attr:
            return True
        have = x.attrs.get(attr, "")
        return bool(have and re.search(value, have)) if pattern else value in (have.split() if attr == "class" else [have])

    return next((x for x in root.walk() if isinstance(x, Node) and x.tag == tag and fits(x)), None)


def _densest(root: Node) -> Node | None:
    """The first ``div`` with the most paragraphs below it, if two or more; else the body."""
    inside: dict[int, int] = {}
    nodes = [x for x in root.walk() if isinstance(x, Node)]
    for x in reversed(nodes):  # children come after their parents
        inside[id(x)] = inside.get(id(x), 0)
        if x.parent is not None:
            inside[id(x.parent)] = inside.get(id(x.parent), 0) + inside[id(x)] + (x.tag == "p")
    best = max((x for x in nodes if x.tag == "div"), key=lambda x: inside[id(x)], default=None)
    if best is not None and inside[id(best)] >= 2:
        return best
    return next((x for x in nodes if x.tag == "body"), None)


def news_article(html: str | None) -> tuple[str, str]:
    """(title, raw lines of the text); empty strings where there is none, null pages too."""
    root = _parse(html or "")
    title = ""
    meta = next((x for x in root.walk() if isinstance(x, Node) and x.tag == "meta" and x.attrs.get("property") == "og:title"), None)
    if meta is not None:
        title = meta.attrs.get("content", "")
    for tag, attr, value in TITLE_PLACES if len(title) <= 5 else ():
        node = _at(root, tag, attr, value, value.startswith("(?i)"))
        if node is not None:
            title = "".join(node.texts())
            if len(title) > 5:
                break
    if not title and (node := _at(root, "title", "", "", False)) is not None:
        title = "".join(node.texts())
    body = next((x for p in BODY_PLACES if (x := _at(root, *p, False)) is not None), None) or _densest(root)
    return title, "\n".join(body.texts(frozenset(PAGE_NOT_TEXT))) if body is not None else ""


def news_articles(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with title and body."""
    at = pages.columns.index(html_col)
    keep = [i for i in range(len(pages.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [news_article(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*(b.schema.names[i] for i in keep), "title", "body"])

    return pages.mapInArrow(run, T.StructType([*(pages.schema.fields[i] for i in keep), T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
