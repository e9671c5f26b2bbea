"""Typed values from free text: application periods, age limits, the age in a question. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the source texts.
ALWAYS, CLOSED, BUDGET, SPENT, FIXED, UNTIL = "상시", "마감", "예산", "소진", "특정기간", "까지"
NO_LIMIT, AT_LEAST, AT_MOST = "제한 없음", "이상", "이하"
YEAR, MONTH, DAY = "년", "월", "일"

# Formats of a day: 2026.1.5, 2026-01-05, 2026/1/5 with blanks, or eight digits in a row; in some sources 2026년 1월 5일 as well.
_DAY_TOKEN = r"(?<!\d)(?:\d{4}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{1,2}|\d{8})(?!\d)"
_DAY_TOKEN_IN_WORDS = rf"(?<!\d)(?:\d{{4}}\s*[{YEAR}./-]\s*\d{{1,2}}\s*[{MONTH}./-]\s*\d{{1,2}}|\d{{8}})(?!\d)"
# A range of months as kinds of tokens, Y a number of four digits and m one of one or two: 2025년 12월 ~ 2026년 2월, 2026.1~3.
_TOKEN = r"\d+|\s+|\S"
_MONTHS_SHAPE = f"Y ?[{YEAR}./-] ?m[{MONTH}.]? ?~ ?(?:Y ?[{YEAR}./-] ?)?m"
_AGE_NUMBER = r"(?<!\d)\d{1,3}(?!\d)"

PERIOD = "struct<start: date, end: date, schedule: string, status: string, issue: string>"
AGE = "struct<low: int, high: int, issue: string>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used: the optimizer does not copy a lambda's argument."""
    return F.transform(F.array(value), use)[0]


def each_once(rows: DataFrame, text: str, name: str, parse: Callable[[Column], Column]) -> DataFrame:
    """rows with parse(text) under a name, each different text parsed once: sources write few periods in very many rows."""
    parsed = rows.select(F.col(text).alias("__text")).distinct().withColumn(name, parse(F.col("__text")))
    return rows.join(parsed, F.col(text).eqNullSafe(F.col("__text")), "left").drop("__text")


def _date(token: Column) -> Column:
    """Null if there is no such day."""
    parts = F.regexp_extract_all(token, F.lit(r"\d+"), F.lit(0))
    pad = lambda i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    flat = F.regexp_replace(token, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(F.size(parts) == 3, F.concat_ws("-", parts[0], pad(1), pad(2))).otherwise(flat).try_cast("date")


def days(text: Column, in_words: bool = False) -> Column:
    """The days that a text names, in order; null for those that don't exist."""
    return F.transform(F.regexp_extract_all(text, F.lit(_DAY_TOKEN_IN_WORDS if in_words else _DAY_TOKEN), F.lit(0)), _date)


def _kind(token: Column) -> Column:
    number = F.length(token)
    return (
        F.when(token.rlike("^[0-9]"), F.when(number == 4, "Y").when(number <= 2, "m").otherwise("n"))
        .when(F.trim(token) == "", " ")
        .when(token.isin(*f"{YEAR}{MONTH}./-~"), token)
        .otherwise(F.when(token.rlike(r"(?U)^\s"), " ").otherwise("x"))
    )


def months(text: Column) -> Column:
    """struct<given: boolean, start: date, end: date> of the first range of months: first day to last day."""
    tokens = F.when(text.contains("~"), F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    first = lambda y, m: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lit("01")).try_cast("date")

    def found(t: Column) -> Column:
        shape = F.array_join(F.transform(t, _kind), "")
        own = F.regexp_extract(shape, _MONTHS_SHAPE, 0)
        numbers = F.filter(F.slice(t, F.greatest(F.regexp_instr(shape, F.lit(_MONTHS_SHAPE)), F.lit(1)), F.length(own)), lambda x: x.rlike("^[0-9]"))
        return F.struct((own != "").alias("given"), numbers.alias("n"))

    def made(given: Column, n: Column) -> Column:
        at = lambda i: F.get(n, F.lit(i))
        end = F.when(F.size(n) == 4, first(at(2), at(3))).when(F.size(n) == 3, first(at(0), at(2)))
        return F.struct(given.alias("given"), F.when(given, first(at(0), at(1))).alias("start"), F.last_day(end).alias("end"))

    return once(once(tokens, found), lambda x: made(x["given"], x["n"]))


def _row(kind: str, **values: Column | str | None) -> Column:
    fields = [f.split(":")[0].strip() for f in kind.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*[(v if isinstance(v := values.get(f), Column) else F.lit(v)).alias(f) for f in fields]).cast(kind)


def _bounded(start: Column, end: Column, as_of: Column, issue: Column | None = None) -> Column:
    status = F.when(as_of < start, "scheduled").when(as_of > end, "closed").otherwise("open")
    return F.when(start > end, _row(PERIOD, issue="invalid_application_date_order")).otherwise(_row(PERIOD, start=start, end=end, schedule="fixed_period", status=status, issue=issue))


def period(text: Column, as_of: Column) -> Column:
    """start, end, schedule, status and issue of an application period; words that settle it come before dates, days before
    months. A lone day is the start unless the text says until. Null text gives nulls."""

    def settled(found: Column, m: Column) -> Column:
        first, second, n = F.get(found, F.lit(0)), F.get(found, F.lit(1)), F.size(found)
        return (
            F.when(text.isNull(), _row(PERIOD))
            .when(text.contains(ALWAYS), _row(PERIOD, schedule="always", status="open"))
            .when(text.contains(CLOSED), _row(PERIOD, status="closed"))
            .when(text.contains(BUDGET) & text.contains(SPENT), _row(PERIOD, schedule="until_budget_exhausted"))
            .when(text == FIXED, _row(PERIOD, schedule="fixed_period"))
            .when(F.exists(found, lambda x: x.isNull()), _row(PERIOD, issue="invalid_application_date"))
            .when(n >= 2, _bounded(first, second, as_of, F.when(n > 2, "extra_application_dates")))
            .when((n == 1) & text.contains(UNTIL), _row(PERIOD, end=first, schedule="fixed_period", status=F.when(as_of > first, "closed").otherwise("open")))
            .when(n == 1, _row(PERIOD, start=first, schedule="fixed_period", status=F.when(as_of < first, "scheduled")))
            .when(~m["given"], _row(PERIOD, issue="unparsed_application_period"))
            .when(m["start"].isNull() | m["end"].isNull(), _row(PERIOD, issue="invalid_application_date"))
            .otherwise(_bounded(m["start"], m["end"], as_of))
        )

    # What is returned is again an array's element, so that reading several of its fields does not repeat the work.
    return once(F.struct(days(text).alias("d"), months(text).alias("m")), lambda x: settled(x["d"], x["m"]))


def age_limits(text: Column, zeros_are_blank: bool = False) -> Column:
    """low, high and issue of an age condition; null text and texts that say no limit have neither."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_AGE_NUMBER), F.lit(0)), lambda x: x.cast("int"))

    def settled(numbers: Column) -> Column:
        first, second, n = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)), F.size(numbers)
        between = text.contains("~") | text.contains("～") | text.rlike(f"{AT_LEAST}.*{AT_MOST}")
        ranged = (n >= 2) & between
        low = F.when(ranged | ((n == 1) & text.contains(AT_LEAST)), first)
        high = F.when(ranged, second).when((n == 1) & ~text.contains(AT_LEAST) & text.contains(AT_MOST), first)
        blank = (low == 0) & (high == 0) if zeros_are_blank else F.lit(False)
        wrong = (low > 150) | (high > 150) | (low > high)
        return (
            F.when(text.isNull() | text.contains(NO_LIMIT), _row(AGE))
            .when(low.isNull() & high.isNull(), _row(AGE, issue=F.when(n > 0, "unparsed_age_condition")))
            .when(blank, _row(AGE, issue="placeholder_age_range"))
            .when(wrong, _row(AGE, issue="invalid_age_range"))
            .otherwise(_row(AGE, low=low, high=high))
        )

    return once(found, settled)


def asked_age(text: Column) -> Column:
    """The age that a question names, 0 to 150."""
    named, plain = F.regexp_extract(text, r"(?:만\s*)?(\d{1,3})\s*(?:세|살)", 1), F.regexp_extract(text, r"만\s*(\d{1,3})", 1)
    found = F.coalesce(F.nullif(named, F.lit("")), F.nullif(plain, F.lit(""))).cast("int")
    return F.when(found <= 150, found)


def keyword(text: Column, words: dict[str, str]) -> Column:
    """Value of the first word, in the order given, that the text contains."""
    out = F.lit(None).cast("string")
    for word, value in reversed(words.items()):
        out = F.when(text.contains(word), value).otherwise(out)
    return out


# Words that name a status or a category in a question, in the order in which they are tried.
STATUS_WORDS = {w: s for s, ws in {
    "open": ("모집중", "신청중", "접수중", "진행중", "모집 중", "신청 중", "접수 중", "진행 중"),
    "scheduled": ("예정", "모집예정", "신청예정", "모집 예정", "신청 예정"),
    "closed": ("마감", "종료", "신청마감", "마감됨"),
}.items() for w in ws}
CATEGORY_WORDS = {w: c for c, ws in {
    "housing": ("단기숙소", "주거", "월세", "전세", "주택", "청년주택", "보증금", "집"),
    "finance": ("금융", "대출", "적금", "자산", "통장", "금리", "목돈", "저축"),
    "welfare": ("복지", "의료", "건강", "수당", "지원금", "생계비"),
    "employment": ("취업", "일자리", "구직", "인턴", "채용", "취업준비", "구직활동"),
    "startup": ("창업", "스타트업", "사업자"),
    "education": ("교육", "장학금", "등록금", "학비", "역량강화"),
}.items() for w in ws}
