"""Values of HTML pages: links, label-value pairs and table rows, and fields by label. One pass of a tag pattern a page, in Arrow batches."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.functions.text import visible

_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", re.I | re.S)
_PAIR = re.compile(r"<(?:dt|th)\b[^>]*>(.*?)</(?:dt|th)\s*>\s*<(?:dd|td)\b[^>]*>(.*?)</(?:dd|td)\s*>", re.I | re.S)
_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr\s*>", re.I | re.S)
_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]\s*>", re.I | re.S)


def _udf(f, kind: str, c: Column | str) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: f(p or ""))

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(c)


def links(page: Column | str) -> Column:
    """array<struct<text, target>> of a page's links, in order."""
    return _udf(lambda p: [(visible(t) or "", unescape(h).strip()) for h, t in _LINK.findall(p)], "array<struct<text: string, target: string>>", page)


def labelled(page: Column | str) -> Column:
    """map<label, value> of definition lists and of table cells beside their heading; the first value of a label counts."""
    return _udf(lambda p: {k: visible(v) or "" for a, v in reversed(_PAIR.findall(p)) if (k := visible(a))}, "map<string, string>", page)


def rows(page: Column | str) -> Column:
    """array<array<string>> of the cells of a page's table rows."""
    return _udf(lambda p: [[visible(c) or "" for c in _CELL.findall(r)] for r in _ROW.findall(p)], "array<array<string>>", page)


def extracted(pages: DataFrame, html: str, fields: dict[str, list[str]]) -> DataFrame:
    """pages with a column for each field: the value of the first of its labels that the page has and that isn't blank.

    A source is a set of labels; nothing here knows one."""
    out = pages.withColumn("__labels", labelled(html))
    for name, labels in fields.items():
        out = out.withColumn(name, F.coalesce(*[F.nullif(F.trim(F.col("__labels")[label]), F.lit("")) for label in labels]))
    return out.drop("__labels")
