"""Cleaning, splitting and wording of texts, and JSON texts: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys whose values are never logged.
REDACTED = ("pin", "token", "password", "secret", "api_key", "authorization", "raw_document", "raw_payload", "sql_parameter", "sql_parameters")
# Formats of days in free texts: 2026-1-5 with blanks; '26년 1월 5일, 2026년 상반기 1.5 and the like.
DAY_IN_MARKS = r"(?<!\d)(?:19|20)\d{2}(?:\s*[./-]\s*\d{1,2}){2}(?!\d)"
DAY_IN_WORDS = r"(?<!\d)(?:19|20)?\d{2}\s*년[^\n]{0,40}?\d{1,2}(?:\s*[./]|\s*월)\s*\d{1,2}(?!\d)"
# Related searches by what triggers them; the triggers are the suggestions.
RELATED = (("주거", "월세", "전세", "청년주택"), ("취업", "일자리", "구직"), ("창업", "스타트업"), ("교육", "장학금"))


# What a sentence ends with, and the marks that set items of a text apart.
SENTENCE_ENDS = (".", "!", "?", "다", "요")
NOTE, BULLETS, CIRCLES = "※", "•*–-", "○●◦"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def list_title(c: Column) -> Column:
    """A list's title without its last word if that marks a new entry or tells its age in days."""
    words = F.split(squeezed(c), " ")
    last = F.lower(F.element_at(words, -1))
    return F.when((F.size(words) > 1) & ((last == "new") | last.rlike(r"^\d+일전$")), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(F.array_join(words, " "))


def sentences(c: Column) -> Column:
    """Sentences of a text: words are added to the last one until it ends."""
    last = lambda acc: F.element_at(acc, -1)
    ended = lambda x: F.substring(x, -1, 1).isin(*SENTENCE_ENDS)
    start = F.expr("CAST(array() AS array<string>)")
    grown = lambda acc, w: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last(acc), w)))
    return F.aggregate(F.split(squeezed(c), " "), start, lambda acc, w: F.when((F.size(acc) == 0) | ended(F.try_element_at(acc, F.lit(-1))), F.array_append(acc, w)).otherwise(grown(acc, w)))


def sentence_with(c: Column, token: str) -> Column:
    """The first sentence that contains the token."""
    return F.get(F.filter(sentences(c), lambda x: x.contains(token)), F.lit(0))


def period_text(start: Column, end: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.nullif(F.concat_ws(" ~ ", blank(start), blank(end)), F.lit(""))


def expanded(c: Column, phrases: dict[str, str]) -> Column:
    """Shorthand phrases in full."""
    for short, full in phrases.items():
        c = F.replace(c, F.lit(short), F.lit(full))
    return c


def section_key(line: Column, names: dict[str, str]) -> Column:
    """The section that a line is the header of, without bullets before it and a bracket at its end; null for other lines."""
    bare = F.regexp_extract(line, rf"^[{CIRCLES}*\s-]*(.*?)\s*(?:\([^)]*\))?\s*$", 1)
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[bare]


def shown_lines(c: Column) -> Column:
    """Lines of a fragment without its tags, blanks squeezed; empty lines are empty strings."""
    return F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""), "\n"), squeezed)


def shown_text(c: Column) -> Column:
    """Text for a page: its lines, with one empty line where there were several."""
    lines = shown_lines(c)
    kept = F.filter(lines, lambda x, i: (x != "") | ((i > 0) & (F.get(lines, i - 1) != "")))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")


def items(c: Column) -> Column:
    """Items of a text by the kind of mark that tells at least two of them apart: numbers before lines, notes, lines with or
    without bullets, semicolons or slashes. A text of which no mark makes two is one item."""
    lines = F.filter(shown_lines(c), lambda x: x != "")
    parted = lambda x, marks: F.filter(F.transform(F.split(x, marks), lambda y: F.trim(y)), lambda y: y != "")
    # A bullet after the end of a sentence begins a line of its own.
    broken = F.regexp_replace(F.array_join(lines, "\n"), rf"([.;!?]) (?=[{BULLETS}])", "$1\n")
    plain = F.filter(F.transform(F.split(broken, "\n"), lambda x: F.ltrim(x, F.lit(BULLETS + " "))), lambda y: y != "")
    by_mark = F.array(
        F.array_compact(F.transform(lines, lambda x: F.nullif(F.regexp_extract(x, r"^\d+[.)] (.+)$", 1), F.lit("")))),
        parted(F.array_join(lines, "\n"), NOTE),
        plain,
        parted(F.array_join(lines, "\n"), r";| / "),
    )
    return F.coalesce(F.get(F.filter(by_mark, lambda x: F.size(x) >= 2), F.lit(0)), plain)


def related_searches(q: Column, groups: tuple[tuple[str, ...], ...] = RELATED) -> Column:
    """Other words of the groups that a query has a word of."""
    said = F.trim(q)
    each = [F.when(F.exists(F.array(*map(F.lit, g)), lambda t: said.contains(t)), F.filter(F.array(*map(F.lit, g)), lambda s: ~said.contains(s))).otherwise(F.array().cast("array<string>")) for g in groups]
    return F.array_distinct(F.flatten(F.array(*each)))


def messages(codes: Column, texts: dict[str, str]) -> Column:
    """Texts of codes, in order; codes without a text are left out."""
    return F.array_join(F.array_compact(F.transform(codes, lambda c: F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[c])), " ")


def keyword_values(text: Column, rules: dict[str, tuple[str, ...]], other: str | None = None) -> Column:
    """Names of the rules of which the text has a word, in order; ``other`` if there is none."""
    found = F.array_compact(F.array(*[F.when(text.rlike("|".join(ws)), n) for n, ws in rules.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)) if other else found)


def names_a_date(text: Column) -> Column:
    """Whether a free text names a day: year, month and day with marks between them, or a year in words (of two digits as well)
    and a month and day up to forty characters after it on its line."""
    return F.coalesce(text.rlike(DAY_IN_MARKS) | text.rlike(DAY_IN_WORDS), F.lit(False))


def region_level(code: Column) -> Column:
    """Level of a ten-digit region code."""
    return F.when(code == "0" * 10, "country").when(code.endswith("0" * 8), "province").otherwise("district")


# JSON -----------------------------------------------------------------------------------------------------------------
def canonical_json(values: dict[str, Column]) -> Column:
    """JSON with sorted keys, no blanks, and nulls written out."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})


def fingerprint(values: dict[str, Column]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(values), 256))


def short_id(*parts: Column, length: int = 12) -> Column:
    """The first hexadecimal digits of a hash of parts on lines of their own."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, length)


def redacted(json_text: Column) -> Column:
    """JSON text with the string values of secret keys blotted out."""
    return F.regexp_replace(json_text, rf'(?i)("(?:[^"]*(?:{"|".join(REDACTED)})[^"]*)"\s*:\s*)"[^"]*"', '$1"***REDACTED***"')


def json_type(variant: Column) -> Column:
    """Type name of a JSON value."""
    kind = F.schema_of_variant(variant)
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(kind == "BIGINT", "integer")
        .when(kind.rlike("^(DOUBLE|DECIMAL)"), "number")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise(F.lower(kind))
    )


def same_but_for(a: Column, b: Column, key: str) -> Column:
    """Whether two JSON texts are equal once a key's string values are left out, at any depth."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, rf'"{key}"\s*:\s*(?:"[^"]*"|null)\s*,?', ""), r",\s*([}\]])", "$1")
    return bare(a).eqNullSafe(bare(b))


def row_contains(word: str) -> Column:
    """Whether any value of a row, as JSON, has the word."""
    return F.to_json(F.struct("*")).contains(word)
