"""Pages as tables of their elements: nested tables, cells and items that nobody closed, and stray end tags read as browsers do.

A page becomes a row an element, numbered in the order of the page, with its parent, so that what is beside, above or inside
an element is a join or a window over these rows. The reader keeps the stack of open elements: some start tags end what is
open (a cell ends a cell, but not one outside its own table), and an end tag ends all that is open inside its element or,
if there is none, nothing. What scripts, styles and templates hold is no text.

Null pages count as empty. A page that ends in the middle of a tag loses that tag alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightweir.functions.text import BREAKING

# Fixed values of HTML: elements without an end, without visible content, and those that end an open paragraph.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
HIDDEN = frozenset({"script", "style", "template", "noscript"})
ENDS_PARAGRAPH = frozenset({"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"})
#: What a start tag ends, and the elements that it doesn't look beyond.
_CELLS, _ITEMS = ({"td", "th"}, {"table", "tr"}), ({"dt", "dd"}, {"dl"})
IMPLIED = {"td": _CELLS, "th": _CELLS, "tr": ({"tr"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": _ITEMS, "dd": _ITEMS, "option": ({"option"}, {"select"})}
_PARAGRAPH = ({"p"}, {"td", "th", "li", "dd", "table", "button"})

NODES = "node int, parent int, tag string, attributes map<string,string>, text string, last int"


class _Reader(HTMLParser):
    """Elements as [parent, tag, attributes, first piece of text, end of pieces, last descendant]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.hidden: str | None = None

    def _cut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.found[i][4:] = [len(self.pieces), len(self.found) - 1]
        del self.open[depth:]

    def _end(self, tags: Iterable[str], bounds: Iterable[str] = ()) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.found[self.open[depth]][1]
            if tag in tags:
                return self._cut(depth)
            if tag in bounds:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            return
        if tag in HIDDEN:
            self.hidden = tag
            return
        if tag in ENDS_PARAGRAPH:
            self._end(*_PARAGRAPH)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in BREAKING:
            self.pieces.append(" ")
        self.found.append([self.open[-1] if self.open else None, tag, {k: v or "" for k, v in reversed(attrs)}, len(self.pieces), len(self.pieces), len(self.found)])
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        self._end({tag}, {"table"} if tag not in ("table", "html", "body") else ())
        if tag in BREAKING:
            self.pieces.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)

    def read(self, page: str, shown: frozenset[str]) -> Iterator[tuple]:
        self.feed(page)
        self.close()
        self._cut(0)
        for i, (parent, tag, attributes, a, b, last) in enumerate(self.found):
            yield i, parent, tag, attributes, " ".join("".join(self.pieces[a:b]).split()) if tag in shown else None, last


def elements(pages: DataFrame, id_col: str, html_col: str, shown: Iterable[str] = ("a", "caption", "dd", "dt", "h1", "h2", "h3", "li", "p", "td", "th", "title")) -> DataFrame:
    """(id, node, parent, tag, attributes, text, last): a row an element; text, with what is inside, of the tags in ``shown``
    alone; an element's descendants are numbered from node + 1 to last."""
    with_text = frozenset(shown)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, page in zip(batch[id_col], batch[html_col], strict=True):
                rows = list(_Reader().read(page or "", with_text))
                if rows:
                    out = pd.DataFrame(rows, columns=["node", "parent", "tag", "attributes", "text", "last"])
                    out.insert(0, id_col, key)
                    yield out.astype({"parent": "Int32"})

    return pages.select(id_col, html_col).mapInPandas(run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, {NODES}")


def labelled(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, node, label, value): cells and list items that stand right after a heading cell or term, in the same row or list."""
    beside = Window.partitionBy(id_col, "parent").orderBy("node")
    own = nodes.where(F.col("tag").isin("th", "td", "dt", "dd"))
    after = own.withColumns({"next_tag": F.lead("tag").over(beside), "value": F.lead("text").over(beside)})
    return after.where(F.col("tag").isin("th", "dt") & (F.col("next_tag") == F.when(F.col("tag") == "th", "td").otherwise("dd")) & (F.col("text") != "")).select(id_col, "node", F.col("text").alias("label"), "value")


def fields(pages: DataFrame, nodes: DataFrame, id_col: str, wanted: dict[str, list[str]]) -> DataFrame:
    """pages with a column for each field: the value of the first of its labels that the page has and that isn't blank; of a
    label that is there again, the first value counts."""
    pairs = labelled(nodes, id_col).where("value <> ''")
    order = lambda labels: F.coalesce(*[F.when(F.col("label") == x, i) for i, x in enumerate(labels)])
    best = pairs.groupBy(id_col).agg(*[F.min_by("value", F.when(F.col("label").isin(labels), F.struct(order(labels).alias("o"), "node"))).alias(name) for name, labels in wanted.items()])
    return pages.join(best, id_col, "left")


def inside(nodes: DataFrame, id_col: str, within: Column, what: Column) -> DataFrame:
    """(id, outer, node, ...): elements that ``what`` holds for, in the nearest element around them that ``within`` holds for."""
    outer = nodes.where(within).select(F.col(id_col).alias("__id"), F.col("node").alias("outer"), F.col("last").alias("__last"))
    inner = nodes.where(what)
    pairs = inner.join(outer, (F.col(id_col) == F.col("__id")) & (F.col("node") > F.col("outer")) & (F.col("node") <= F.col("__last")))
    return pairs.groupBy(*nodes.columns).agg(F.max("outer").alias("outer"))


def sections(nodes: DataFrame, id_col: str, heading: Column, body: Column) -> DataFrame:
    """(id, section, lines): texts of elements under the latest heading before them, in order."""
    at = F.last(F.when(heading, F.col("node")), True).over(Window.partitionBy(id_col).orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    own = nodes.where(heading | body).withColumn("head", at)
    heads = own.where(heading).select(id_col, F.col("node").alias("head"), F.col("text").alias("section"))
    lines = own.where(body & ~heading & (F.col("text") != "")).groupBy(id_col, "head").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]).alias("lines"))
    return heads.join(lines, [id_col, "head"], "left").select(id_col, "section", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
