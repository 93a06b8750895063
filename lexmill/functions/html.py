"""HTML to title, prose, code and links with the standard library's parser, as Arrow batches in Python workers.

Only parsing runs in Python, as nothing built in reads HTML; URL filters and clean-up of the results are columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PROSE = frozenset("p li td th dt dd h1 h2 h3 h4 h5".split())
_MAIN = re.compile(r"\b(body|content|main|article|document)\b", re.IGNORECASE)
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []

    def walk(self, skip: frozenset[str] = frozenset()) -> Iterator[Node | str]:
        """The nodes and texts below, in document order, iteratively: pages may nest deeply. `skip` is left out whole."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in skip:
                yield x
                stack.extend(reversed(x.children))

    def text(self, between: str = "", strip: bool = False, skip: frozenset[str] = frozenset()) -> str:
        parts = (x for x in self.walk(skip) if isinstance(x, str))
        return between.join(p for x in parts if (p := x.strip() if strip else x) or not strip)


class Tree(HTMLParser):
    """A tree in which an end tag closes the nearest open element of its name; strays are ignored, open ones nest."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


_CODE = frozenset({"pre", "code"})


def _outer_code(node: Node) -> Iterator[Node]:
    """Code elements that lie in no other, in document order."""
    stack = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.name in _CODE:
                yield x
            else:
                stack.extend(reversed(x.children))


_HIDDEN = frozenset({"script", "style", "template"})


def split_body(html: str | None) -> tuple[str, str]:
    """(prose, code) of a question's or answer's body: code elements stripped and joined by line ends, the rest by spaces."""
    if not html:
        return "", ""
    root = Tree(html).root
    code = [t for c in _outer_code(root) if (t := c.text().strip())]
    return _BLANK.sub(" ", root.text(" ", True, _CODE | _HIDDEN)).strip(), "\n".join(code)


def parse_page(url: str, html: str | None) -> tuple[str, str, str, list[str]]:
    """(title, prose, code, links) of a page, before clean-up. Links are absolute, without fragments, unfiltered."""
    root = Tree(html or "").root
    first = {}
    main = None
    for x in root.walk():
        if isinstance(x, Node):
            first.setdefault(x.name, x)
            if main is None and x.name == "div" and any(_MAIN.search(c) for c in [*x.attrs.get("class", "").split(), x.attrs.get("class", "")]):
                main = x
    title = first["h1"].text("", True) if "h1" in first else first["title"].text("", True) if "title" in first else url
    main = main or first.get("main") or first.get("article") or first.get("body") or root
    inside = set()
    code = []
    for c in _outer_code(main):
        t = c.text()
        if t.strip():
            code.append(t)
        inside.update(id(x) for x in [c, *c.walk()] if isinstance(x, Node))
    prose = [t for x in main.walk(_CODE) if isinstance(x, Node) and x.name in _PROSE and (t := x.text(" ", True, _CODE | _HIDDEN))]
    links = []
    for x in root.walk():
        if isinstance(x, Node) and x.name == "a" and "href" in x.attrs and id(x) not in inside:
            try:
                links.append(urldefrag(urljoin(url, x.attrs["href"]))[0])
            except ValueError:  # not a URL, such as a broken IPv6 host
                continue
    return title, " ".join(prose).strip(), "\n".join(code).strip(), links


_TEXT = T.StringType()


@F.pandas_udf(T.StructType([T.StructField("prose", _TEXT), T.StructField("code", _TEXT)]))
def body_parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_body(h) for h in html], columns=["prose", "code"])


@F.pandas_udf(T.StructType([*(T.StructField(f, _TEXT) for f in ("title", "prose", "code")), T.StructField("links", T.ArrayType(_TEXT))]))
def page_parts(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(u or "", h) for u, h in zip(url, html, strict=True)], columns=["title", "prose", "code", "links"])
