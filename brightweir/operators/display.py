"""What a reader of the catalog sees: deadlines, badges, periods, ages, regions, calendars, client filters and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.functions.periods import days_left

KNOWN_CATEGORIES = ("housing", "finance", "welfare", "employment", "startup", "education", "other")
# Words that are shown.
SCHEDULES = {"always": "상시", "fixed_period": "기간 모집", "until_budget_exhausted": "예산 소진 시"}
STATUSES = {"open": "모집중", "scheduled": "예정", "closed": "마감"}
SOON, UNSURE, NO_AGE, NO_REGION, NO_PERIOD = "마감임박", "정보 미확인", "연령 정보 없음", "지역 미정", "기간 미정"


def deadline(status: Column, schedule: Column, end: Column, today: Column) -> Column:
    """closed, always, unknown, upcoming, today or past."""
    n = days_left(end, today)
    return (
        F.when(status == "closed", "closed")
        .when((schedule == "always") & (status == "open") & end.isNull(), "always")
        .when(end.isNull(), "unknown")
        .when(n > 0, "upcoming")
        .when(n == 0, "today")
        .otherwise("past")
    )


def deadline_label(kind: Column, end: Column, today: Column) -> Column:
    return F.when(kind.isin("closed", "past"), "마감").when(kind == "always", "상시").when(kind == "unknown", "일정 미정").when(kind == "today", "D-Day").otherwise(F.concat(F.lit("D-"), days_left(end, today)))


def imminent(kind: Column, end: Column, today: Column, within: int = 7) -> Column:
    return F.coalesce(kind.isin("upcoming", "today") & days_left(end, today).between(0, within), F.lit(False))


def featured(kind: Column, status: Column) -> Column:
    """Worth showing first: open and not past."""
    return F.coalesce(status == "open", F.lit(False)) & ~kind.isin("closed", "past")


def badge(status: Column, schedule: Column, quality: Column, soon: Column) -> Column:
    """The one badge of a card, by precedence."""
    named = F.create_map(*[F.lit(x) for kv in SCHEDULES.items() for x in kv])
    return (
        F.when((schedule == "always") & (status == "open"), SCHEDULES["always"])
        .when(quality == "partial", UNSURE)
        .when(soon, SOON)
        .when(status == "open", STATUSES["open"])
        .when(status == "scheduled", STATUSES["scheduled"])
        .when(status == "closed", STATUSES["closed"])
        .when(status.isNotNull(), status)
        .when(schedule.isNotNull(), F.coalesce(named[schedule], schedule))
        .otherwise("정책")
    )


def badges(status: Column, schedule: Column, quality: Column, soon: Column) -> Column:
    """All badges of a detail page: schedule, quality, deadline, status; the card's badge if there is none."""
    named, told = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (SCHEDULES, STATUSES))
    own = F.array_compact(F.array(F.coalesce(named[schedule], schedule), F.when(quality == "partial", UNSURE), F.when(soon, SOON), F.coalesce(told[status], status)))
    return F.when(F.size(own) > 0, own).otherwise(F.array(badge(status, schedule, quality, soon)))


def dotted(day: Column) -> Column:
    return F.date_format(day, "yyyy.MM.dd")


def period_card(start: Column, end: Column, schedule: Column, text: Column, longest: int = 48) -> Column:
    """Period of a card: days with dots, else the text with its days written alike, cut at ``longest`` characters."""
    t = F.regexp_replace(F.regexp_replace(text, r"\b(\d{4})(\d{2})(\d{2})\b", "$1.$2.$3"), r"\b(\d{4})-(\d{2})-(\d{2})\b", "$1.$2.$3")
    t = F.trim(F.regexp_replace(t, r"\s{2,}", " "))
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat_ws(" ~ ", dotted(start), dotted(end)))
        .when(end.isNotNull(), F.concat(dotted(end), F.lit(" 마감")))
        .when(start.isNotNull(), F.concat(dotted(start), F.lit(" 시작")))
        .when(schedule == "always", SCHEDULES["always"])
        .when(F.coalesce(text, F.lit("")) != "", F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("…"))).otherwise(t))
        .otherwise(NO_PERIOD)
    )


def age_label(low: Column, high: Column, text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    return (
        F.when(((low == 0) & (high == 0)) | bare.isin("0세~0세", "0~0"), NO_AGE)
        .when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("세 ~ "), high, F.lit("세")))
        .when(low.isNotNull(), F.concat(low, F.lit("세 이상")))
        .when(high.isNotNull(), F.concat(high, F.lit("세 이하")))
        .otherwise(F.coalesce(text, F.lit(NO_AGE)))
    )


def region_label(regions: Column, text: Column, most: int = 2) -> Column:
    n = F.size(regions)
    head = F.array_join(F.slice(regions, 1, most), ", ")
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.coalesce(text, F.lit(NO_REGION))).when(n <= most, head).otherwise(F.concat(head, F.lit(" 외 "), n - most, F.lit("곳")))


def category_order(categories: Column, first: str | None = None) -> Column:
    own = F.array_distinct(categories)
    if first is not None:
        own = F.when(F.array_contains(own, first), F.concat(F.array(F.lit(first)), F.array_remove(own, first))).otherwise(own)
    return F.when(F.coalesce(F.size(categories), F.lit(0)) <= 0, F.array(F.lit("other"))).otherwise(own)


def client_filter(search: str = "", region: str = "", category: str = "", age: int | None = None) -> Column:
    """The browser's filter: one text of all fields, region or nationwide, category, age; rows without bounds pass any age."""
    cols = ["title", "organization", "support_content", "category_text", "eligibility_text", "region_text", "age_text"]
    keep = F.lit(True)
    if search.strip():
        keep = keep & F.lower(F.concat_ws(" ", *cols)).contains(search.strip().lower())
    if region:
        keep = keep & (F.array_contains("regions", "전국") | F.array_contains("regions", region))
    if category:
        keep = keep & F.array_contains("categories", category)
    if age is not None:
        within = F.lit(age).between(F.coalesce("age_min", F.lit(0)), F.coalesce("age_max", F.lit(150)))
        keep = keep & F.lit(0 <= age <= 150) & ((F.col("age_min").isNull() & F.col("age_max").isNull()) | within)
    return F.coalesce(keep, F.lit(False))


def calendar_filter(categories: Column, enabled: tuple[str, ...]) -> Column:
    """Any category is switched on; unknown ones and none count as other."""
    on = lambda c: F.when(c.isin(*KNOWN_CATEGORIES), c).otherwise("other").isin(*enabled)
    return F.when(F.coalesce(F.size(categories), F.lit(0)) <= 0, F.lit("other" in enabled)).otherwise(F.exists(categories, on))


def admin_region_filter(regions: Column, region: str) -> Column:
    return (F.coalesce(F.size(regions), F.lit(0)) <= 0) | F.array_contains(regions, "전국") | F.array_contains(regions, region)


def client_order(sort: str) -> list[Column]:
    """The browser's order: titles by Korean collation, days with nulls last, id."""
    title = F.collate("title", "ko")
    keys = {"title_asc": title.asc(), "title_desc": title.desc(), "deadline_asc": F.col("application_end").asc_nulls_last(), "deadline_desc": F.col("application_end").desc_nulls_last(), "collected_desc": F.col("collected_at").desc(), "collected_asc": F.col("collected_at").asc()}
    return [*([keys[sort]] if sort in keys else []), F.col("id")]


def calendar_events(policies: DataFrame) -> DataFrame:
    """(id, kind, day, title): start and end days, each once, for ordering by day, start before end, title."""
    one = lambda kind, day: policies.where(F.col(day).isNotNull()).select("id", F.lit(kind).alias("kind"), F.col(day).alias("day"), "title")
    return one("start", "application_start").unionByName(one("end", "application_end")).dropDuplicates(["id", "kind", "day"])


def event_order() -> list[Column]:
    return [F.col("day"), (F.col("kind") == "end").cast("int"), F.collate("title", "ko"), F.col("id")]


def alerts(policies: DataFrame, favourites: DataFrame, today: Column, within: int = 7) -> DataFrame:
    """Favourites that end within some days: (id, days), to be read by days, then id."""
    own = policies.join(favourites.select("id").distinct(), "id", "left_semi")
    return own.where(days_left(F.col("application_end"), today).between(0, within)).select("id", days_left(F.col("application_end"), today).alias("days"))


def option_list(df: DataFrame, col: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The different values of an array column but for some, to be shown in order."""
    return df.select(F.explode(col).alias("option")).where(~F.col("option").isin(*without) if without else F.lit(True)).distinct()


def folder_counts(folders: DataFrame, items: DataFrame) -> DataFrame:
    """folders (folder, pinned), items (folder, id): how many different items each has; empty folders count none."""
    per = items.groupBy("folder").agg(F.count_distinct("id").alias("n"))
    return folders.join(per, "folder", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def page_strip(current: int, pages: int, around: int = 2) -> list[int | None]:
    """Page numbers to offer: the first, the last and those around the current one; None for a gap."""
    shown = sorted({1, pages, *range(max(1, current - around), min(pages, current + around) + 1)} - {0})
    out: list[int | None] = []
    for p in shown:
        out += [None] * bool(out and p - (out[-1] or p) > 1) + [p]
    return out


def search_state(params: dict[str, str], sorts: tuple[str, ...], most: int = 100) -> dict:
    """Values of an address's parameters: numbers forced into range, unknown sorts to the default."""
    number = lambda k, lo, hi, other: min(max(int(params[k]), lo), hi) if params.get(k, "").lstrip("-").isdigit() else other
    return {"page": number("page", 1, 10**6, 1), "size": number("size", 1, most, 20), "age": number("age", 0, 150, None), "sort": s if (s := params.get("sort", "")) in sorts else "default"}


def region_groups(regions: DataFrame) -> DataFrame:
    """regions (code, parent, name), provinces those below the root: (province, districts: array<struct<label, value>> by
    label), for a choice in two steps."""
    root = regions.where("parent IS NULL").select(F.col("code").alias("parent"))
    provinces = regions.join(root, "parent", "left_semi").select(F.col("code").alias("parent"), F.col("name").alias("province"))
    own = regions.join(provinces, "parent")
    per = own.groupBy("province").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("label"), F.concat_ws(" ", "province", "name").alias("value")))).alias("districts"))
    return provinces.select("province").join(per, "province", "left").withColumn("districts", F.coalesce("districts", F.array().cast("array<struct<label: string, value: string>>")))


def split_regions(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """asked (region) with province and district: of a province's name, or of a district's with its province; empty for others."""
    known = groups.select(F.col("province").alias("__of"), F.explode(F.array_union(F.array("province"), F.transform("districts", lambda x: x["value"]))).alias("__value"))
    rows = asked.withColumn("__said", F.trim("region")).join(known, F.col("__said") == F.col("__value"), "left")
    return rows.select(*asked.columns, F.coalesce("__of", F.lit("")).alias("province"), F.when(F.col("__of").isNotNull() & (F.col("__said") != F.col("__of")), F.col("__said")).otherwise("").alias("district"))
