"""Text functions: folding, patterns, addresses, visible text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{7,}[0-9]"


def fold(c: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def _arrow(f: Callable[[str], str | None], c: ColumnOrName) -> Column:
    """f over the values of a column in Arrow batches; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def compatible(c: ColumnOrName) -> Column:
    """NFKC, white space as single spaces; null if nothing is left. There is no built-in for NFKC."""
    return _arrow(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()) or None, c)


def compatible_all(values: Column) -> Column:
    """``compatible`` of each string of an array, without those of which nothing is left."""
    each = _arrow(lambda t: "\x1f".join(x for v in t.split("\x1f") if (x := " ".join(unicodedata.normalize("NFKC", v).split()))), F.array_join(values, "\x1f"))
    return F.when(F.size(values) > 0, F.filter(F.split(each, "\x1f"), lambda x: x != "")).otherwise(values)


def comparable(c: ColumnOrName) -> Column:
    """NFKC, case folded, letters and digits only."""
    return _arrow(lambda t: "".join(x for x in unicodedata.normalize("NFKC", t).casefold() if x.isalnum()), c)


# Tags that end a line of visible text, and those whose content is never seen.
BREAKING = frozenset({"br", "div", "li", "p", "section", "table", "td", "th", "tr"})
UNSEEN = "script|style"
_TOKEN = re.compile(rf"<({UNSEEN})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<![^>]*>|</?([a-z][a-z0-9]*)\b[^>]*>", re.I | re.S)


def visible(html: str) -> str | None:
    """One pass over the tags: breaking ones become a space, the others go, and what is left has its entities decoded."""
    shown = _TOKEN.sub(lambda m: " " if m[2] and m[2].lower() in BREAKING else "", html)
    return " ".join(unescape(shown).split()) or None


def visible_text(c: ColumnOrName) -> Column:
    """Text of an HTML fragment without scripts and styles, block tags as spaces, entities decoded."""
    return _arrow(visible, c)


def comparison_url(url: Column, https_only: bool = False, keep_port: bool = False) -> Column:
    """An address for comparison: https, host in lower case (with its port if that is to stay), path or a slash, all parameters
    sorted, no fragment; null for other schemes."""
    part = lambda k: F.regexp_extract(F.trim(url), r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(?:\?([^#]*))?", k)
    fits = F.lower(part(1)) == "https" if https_only else part(1) != ""
    query = F.array_join(F.array_sort(F.filter(F.split(part(5), "&"), lambda q: q != "")), "&")
    path = F.when(part(4) == "", "/").otherwise(part(4))
    made = F.concat(F.lit("https://"), F.lower(part(2)), part(3) if keep_port else F.lit(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(fits, made)


def canonical_url(url: Column, drop_prefix: str = "utm_") -> Column:
    """Scheme and host in lower case, no fragment, no parameters of the prefix, the others sorted, no slash at the end."""
    head = F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda q: (q != "") & ~q.startswith(drop_prefix))), "&")
    return F.concat(head, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def folded_value(t: str) -> str:
    """NFKC, white space as single spaces, case folded."""
    return " ".join((t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)).split()).casefold()


def folded(c: Column) -> Column:
    """``folded_value`` of a column; null counts as empty. Values of ASCII alone don't leave the JVM."""
    other = _arrow(folded_value, F.when(c.rlike(r"[^\x00-\x7F]"), c))
    return F.coalesce(other, F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))


def term_hits(field: Column, terms: list[str]) -> Column:
    """Terms that the field (from ``folded``) contains, as they are or with spaces taken out of both."""
    bare = F.replace(field, F.lit(" "), F.lit(""))
    own = list(dict.fromkeys(x for t in terms if (x := folded_value(t))))
    return F.array_compact(F.array(*[F.when(field.contains(x) | bare.contains(x.replace(" ", "")), F.lit(x)) for x in own]))
