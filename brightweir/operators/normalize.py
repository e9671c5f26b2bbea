"""Normalised values of a policy from the texts of its source: categories, regions, availability, ages, links, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightweir.functions import parsing

# Category words of the sources, in the order of the contract's categories.
CATEGORIES = {
    "housing": ("주거",),
    "finance": ("금융", "서민금융", "금융·생활지원", "금융·복지·문화"),
    "welfare": ("복지", "복지·문화", "생활지원", "신체건강", "정신건강", "문화·여가", "안전·위기", "보육", "보호·돌봄", "금융·복지·문화"),
    "employment": ("취업", "일자리", "취업·일자리"),
    "startup": ("창업",),
    "education": ("교육", "장학금", "직업훈련", "교육·직업훈련"),
    "other": ("기타",),
}
# Short names of regions, and endings of whole names.
SHORT_REGIONS = {
    "서울특별시": ("서울", "서울시"), "부산광역시": ("부산", "부산시"), "대구광역시": ("대구", "대구시"), "인천광역시": ("인천", "인천시"),
    "광주광역시": ("광주", "광주시"), "대전광역시": ("대전", "대전시"), "울산광역시": ("울산", "울산시"), "세종특별자치시": ("세종", "세종시"),
    "경기도": ("경기",), "강원특별자치도": ("강원",), "충청북도": ("충북",), "충청남도": ("충남",), "전북특별자치도": ("전북",), "전라남도": ("전남",),
    "경상북도": ("경북",), "경상남도": ("경남",), "제주특별자치도": ("제주", "제주도"), "포항시": ("포항",), "전국": ("전국",),
}
REGION_ENDINGS = ("특별시", "광역시", "특별자치시", "특별자치도", "도", "시", "군", "구")
# Endings taken off a name, the first that fits.
SUFFIXES = ("특별자치시", "특별자치도", "광역시", "특별시", "자치구", "시", "군", "구", "도")
# The word for the whole country, marks of youth, words of questions that say nothing, keys whose values are secret.
NATIONWIDE = "전국"
YOUTH = ("청년", "청소년", "대학생")
FILLERS = ("사는", "거주하는", "받는", "받을", "수", "있나", "있나요", "있어", "있을까", "알려줘", "찾아줘", "추천해줘")
SECRET_KEYS = ("key", "token", "secret", "password", "apikey", "servicekey", "authkey")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def tokens(text: Column, separators: str) -> Column:
    """Trimmed parts that aren't empty; null for null."""
    return F.filter(F.transform(F.split(text, separators), lambda x: F.trim(x)), lambda x: x != "")


def categories(text: Column) -> Column:
    """struct<categories: array<string>, unmapped: boolean> of a text with commas; unknown words are 'other' and noted."""
    known = F.create_map(*[F.lit(w) if i == 0 else F.array(*[F.lit(c) for c, ws in CATEGORIES.items() if w in ws]) for w in dict.fromkeys(w for ws in CATEGORIES.values() for w in ws) for i in (0, 1)])
    words = F.transform(tokens(text, ","), lambda x: F.replace(x, F.lit("･"), F.lit("·")))
    each = F.transform(words, lambda w: F.coalesce(known[w], F.array(F.lit("other"))))
    found = F.coalesce(F.array_distinct(F.flatten(each)), F.array().cast("array<string>"))
    return F.struct(found.alias("categories"), F.coalesce(F.exists(words, lambda w: known[w].isNull()), F.lit(False)).alias("unmapped"))


def region_names(text: Column) -> Column:
    """struct<regions: array<string>, issue: string>: short names in full, whole names as they are, others noted; lists of
    five-digit codes need a code table and are noted as such."""
    short = _lookup({s: full for full, ws in SHORT_REGIONS.items() for s in ws})
    codes = text.rlike(r"^\d{5}(?:\s*,\s*\d{5})*$")
    words = tokens(text, "[,|/]")
    named = F.transform(words, lambda w: F.coalesce(short[w], F.when(w.rlike(f"(?:{'|'.join(REGION_ENDINGS)})$"), w)))
    found = F.when(~codes, F.array_distinct(F.array_compact(named)))
    issue = F.when(codes, "unmapped_region_code").when(F.exists(named, lambda x: x.isNull()), "unmapped_region")
    return F.struct(F.coalesce(found, F.array().cast("array<string>")).alias("regions"), issue.alias("issue"))


def code_evidence(text: Column) -> Column:
    """struct<scope: string, codes: array<string>> of a list of five-digit codes, or of the word for the whole country."""
    said = F.nullif(F.trim(text), F.lit(""))
    codes = tokens(said, ",")
    good = (F.size(codes) > 0) & F.forall(codes, lambda c: c.rlike(r"^[0-9]{5}$"))
    scope = F.when(said == NATIONWIDE, "nationwide").when(F.coalesce(good, F.lit(False)), "regional").otherwise("unknown")
    return F.struct(scope.alias("scope"), F.when(scope == "regional", codes).otherwise(F.array().cast("array<string>")).alias("codes"))


def without_suffix(name: Column) -> Column:
    """A region's name without its administrative ending, if two characters or more are left; else null."""
    said, out = F.trim(name), F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        short = F.trim(F.substring(said, F.lit(1), F.length(said) - len(s)))
        out = F.when(said.endswith(s), F.when(F.length(short) >= 2, short)).otherwise(out)
    return out


def resolve(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (key, name), names (name, code): (key, name, state, codes); no code is unmapped, one matched, several ambiguous.

    Serves aliases, external codes and names without endings alike; what is allowed is up to ``names``."""
    per = names.distinct().groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    out = asked.join(per, "name", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    state = F.when(F.size("codes") == 0, "unmapped").when(F.size("codes") == 1, "matched").otherwise("ambiguous")
    return out.select("key", "name", state.alias("state"), "codes")


def mention(questions: DataFrame, names: DataFrame) -> DataFrame:
    """questions (key, text), names (name, tier): (key, name), for each text the name it contains of the lowest tier, of these
    the longest, then the first. Names are looked up by all substrings of a text of the lengths that names have: an equi-join."""
    lengths = [r[0] for r in names.select(F.length("name")).distinct().collect()]  # a few small numbers
    if not lengths:
        return questions.select("key", F.lit(None).cast("string").alias("name"))


    def parts_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.substring("text", i, F.lit(n)))

    grams = F.flatten(F.array(*[parts_of(n) for n in sorted(lengths)]))
    parts = questions.select("key", F.explode(F.array_distinct(grams)).alias("name")).where(F.length("name").isin(lengths))
    best = parts.join(names, "name").groupBy("key").agg(F.min(F.struct("tier", (-F.length("name")).alias("shorter"), "name"))["name"].alias("name"))
    return questions.select("key").join(best, "key", "left")


def unread_terms(text: Column, consumed: Column) -> Column:
    """Words of a question that neither are fillers nor overlap (either way) with what was read already."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.btrim(w, F.lit(",.!?~[]()")))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*FILLERS) & ~F.exists(consumed, lambda c: w.contains(c) | c.contains(w)))


def region_contract(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """evidence (policy, pos, relation, source_text), names (name, code, full_name): one row a policy with regions (of matched
    includes, in order), scope, rules (relation/state/code in order, each once) and issues.

    A rule is matched if its text has exactly one code; a policy with a matched include is regional, all others unknown."""
    per = names.groupBy("name").agg(F.collect_set(F.struct("code", "full_name")).alias("found"))
    rows = evidence.join(per, evidence["source_text"] == per["name"], "left").withColumn("n", F.coalesce(F.size("found"), F.lit(0)))
    state = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmapped")
    rows = rows.select("policy", "pos", "relation", state.alias("state"), F.when(F.col("n") == 1, F.col("found")[0]["code"]).alias("code"), F.when(F.col("n") == 1, F.col("found")[0]["full_name"]).alias("full"), "source_text")
    # The first of equal rules stands.
    same = F.when(F.col("state") == "matched", F.col("code")).otherwise(F.col("source_text"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("policy", "relation", F.col("state") == "matched", same).orderBy("pos"))).where("nth = 1")
    told = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("/", "relation", "state", F.coalesce("code", "source_text")).alias("rule"), F.when((F.col("state") == "matched") & (F.col("relation") == "include"), F.col("full")).alias("full"), "state"))).alias("all")
    out = rows.groupBy("policy").agg(told)
    names_ = F.array_distinct(F.array_compact(F.transform("all", lambda x: x["full"])))
    issues = F.array_compact(F.transform("all", lambda x: F.when(x["state"] == "ambiguous", "ambiguous_region").when(x["state"] == "unmapped", "unmapped_region_code")))
    return out.select("policy", names_.alias("regions"), F.when(F.size(names_) > 0, "regional").otherwise("unknown").alias("scope"), F.transform("all", lambda x: x["rule"]).alias("rules"), issues.alias("issues"))


def availability(text: Column, as_of: Column, scope_is_open: Column | None = None) -> Column:
    """struct<state: string, reason: string> of a regional source's application period: open, closed, scheduled or
    review_required. Words come before days, days before months; a lone day is the end."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    scope = F.lit(False) if scope_is_open is None else F.coalesce(scope_is_open, F.lit(False))
    says = lambda *w: t.rlike("|".join(w))
    days = parsing.days(t, in_words=True)
    months = parsing.months(t)
    row = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))

    def between(start: Column, end: Column) -> Column:
        return (
            F.when(start > end, row("review_required", "application_period_invalid"))
            .when(as_of < start, row("scheduled", "application_not_started"))
            .when(as_of > end, row("closed", "application_period_ended"))
            .otherwise(row("open", "application_period_open"))
        )

    def settled(d: Column, m: Column) -> Column:
        return (
            F.when(t.isNull(), F.when(scope, row("open", "source_scope_application_open")).otherwise(row("review_required", "application_period_missing")))
            .when(says("마감", "접수 종료", "신청 종료"), row("closed", "application_explicitly_closed"))
            .when(says("상시"), row("open", "application_always_open"))
            .when(says("예산") & says("소진"), F.when(says("접수중", "모집중"), row("open", "application_open_until_budget")).otherwise(row("review_required", "budget_exhaustion_state_unknown")))
            .when(F.exists(d, lambda x: x.isNull()), row("review_required", "application_period_invalid"))
            .when(F.size(d) >= 2, between(F.get(d, F.lit(0)), F.get(d, F.lit(1))))
            .when(F.size(d) == 1, F.when(as_of > F.get(d, F.lit(0)), row("closed", "application_period_ended")).otherwise(row("open", "application_period_open")))
            .when(m["given"] & (m["start"].isNull() | m["end"].isNull()), row("review_required", "application_period_invalid"))
            .when(m["given"], between(m["start"], m["end"]))
            .when(says("접수중", "모집중", "신청 가능"), row("open", "application_explicitly_open"))
            .when(scope, row("open", "source_scope_application_open"))
            .otherwise(row("review_required", "application_period_unresolved"))
        )

    return parsing.once(F.struct(days.alias("d"), months.alias("m")), lambda x: settled(x["d"], x["m"]))


#: A day at the end of what stands before a tilde, with a few words after it, and one at the start of what stands behind.
_DAY_BEFORE = r"(20\d{2})[./-]\s*(\d{1,2})[./-]\s*(\d{1,2})[^|]{0,30}$"
_DAY_BEHIND = r"^\s*(?:(20\d{2})[./-]\s*)?(\d{1,2})[./-]\s*(\d{1,2})"


def ranges(text: Column) -> Column:
    """Date ranges with a tilde; the end's year may be left out. Impossible and reversed ones are dropped.

    The text is gone through from tilde to tilde; a day that ended a range does not begin the next one."""

    def day(c: Column, pattern: str, year: Column | None = None) -> Column:
        part = lambda k: F.regexp_extract(c, pattern, k)
        own = part(1) if year is None else F.coalesce(F.nullif(part(1), F.lit("")), year)
        return F.concat_ws("-", own, F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")

    def step(acc: Column, piece: Column) -> Column:
        paired = acc["left"].rlike(_DAY_BEFORE) & piece.rlike(_DAY_BEHIND)
        span = F.struct(day(acc["left"], _DAY_BEFORE).alias("start"), day(piece, _DAY_BEHIND, F.regexp_extract(acc["left"], _DAY_BEFORE, 1)).alias("end"))
        return F.struct(F.when(paired, F.regexp_replace(piece, _DAY_BEHIND, "")).otherwise(piece).alias("left"), F.when(paired & (span["start"] <= span["end"]), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    pieces = F.split(text, "~")
    start = F.struct(F.get(pieces, F.lit(0)).alias("left"), F.expr("CAST(array() AS array<struct<start: date, end: date>>)").alias("out"))
    return F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


def supplemental_availability(text: Column, as_of: Column) -> Column:
    """open if any range holds the day, closed if all have ended, else unknown; without ranges by words."""
    return parsing.once(
        ranges(text),
        lambda r: F.when(F.size(r) > 0, F.when(F.exists(r, lambda x: (x["start"] <= as_of) & (as_of <= x["end"])), "open").when(F.forall(r, lambda x: as_of > x["end"]), "closed").otherwise("unknown"))
        .when(text.rlike("마감|종료|신청불가"), "closed")
        .when(text.rlike("상시|수시|신청 가능|접수중"), "open")
        .otherwise("unknown"),
    )


def period_consistent(text: Column, start: Column, end: Column, schedule: Column, status: Column, as_of: Column) -> Column:
    """Whether period, schedule and status of a row agree with each other as of a day."""
    none, lone = start.isNull() & end.isNull(), F.lit(False)
    fixed = (
        F.when(none, status.isNull())
        .when(start.isNull(), lone)
        .when(end.isNull(), status.eqNullSafe(F.when(as_of < start, "scheduled")))
        .otherwise(status.eqNullSafe(F.when(as_of < start, "scheduled").when(as_of > end, "closed").otherwise("open")))
    )
    return (
        F.when(text.isNull() & none & schedule.isNull() & status.isNull(), F.lit(True))
        .when(text.isNull() | (start > end), lone)
        .when(schedule == "always", none & status.eqNullSafe(F.lit("open")))
        .when(schedule == "until_budget_exhausted", none & status.isNull())
        .when(schedule == "fixed_period", fixed)
        .when(schedule.isNotNull(), lone)
        .when(status == "closed", text.contains("마감") & none)
        .otherwise(status.isNull() & none)
    )


def age_text(limited: Column, low: Column, high: Column) -> Column:
    """The words for a source's age fields; limited is 'N' where there is no limit."""
    low, high = F.nullif(F.trim(low), F.lit("")), F.nullif(F.trim(high), F.lit(""))
    return F.when(limited == "N", "연령 제한 없음").when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("세 ~ "), high, F.lit("세"))).when(low.isNotNull(), F.concat(low, F.lit("세 이상"))).when(high.isNotNull(), F.concat(high, F.lit("세 이하")))


def source_text(value: Column) -> Column:
    """Line ends as line feeds, trimmed; empty and dashes are null."""
    t = F.regexp_replace(F.regexp_replace(value, "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")
    return F.when(~t.isin("", "-", "--"), t)


def public_contact(value: Column) -> Column:
    """Contact text without addresses, mobile numbers, the labels that these leave at the end, and empty lines."""
    t = F.regexp_replace(value, r"\b[^\s@]+@[^\s@]+\b", "")
    t = F.regexp_replace(t, r"(?<!\d)(?:\+?82[-.\s]?(?:\(0\))?[-.\s]?10|01[016789])[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)", "")
    t = F.regexp_replace(t, r"\s*[/|,;]?\s*(?:담당자(?:\s*연락처)?|휴대전화|핸드폰)\s*$", "")
    t = F.regexp_replace(t, r"\s*[/|,;]\s*(?=$|\n)", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" /|,;"))), lambda x: x != "")
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def preferred(detail: Column, listed: Column) -> Column:
    """The detail page's value unless it is blank."""
    return F.coalesce(F.nullif(F.trim(detail), F.lit("")), F.nullif(F.trim(listed), F.lit("")))


def observation(labels: Column, label: str) -> Column:
    """Whether a page's labels (a map) have a label, and a value for it."""
    return F.when(~F.coalesce(F.map_contains_key(labels, label), F.lit(False)), "label_not_found").when(F.coalesce(F.trim(labels[label]), F.lit("")) == "", "label_present_value_empty").otherwise("value_extracted")


def has_zone(value: Column) -> Column:
    """The instant of an ISO text with an offset; null without one or if it can't be read."""
    return F.when(value.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(value))


def safe_url(url: Column) -> Column:
    """The address if it is public: http or https with a host, a port in range, no blanks, credentials or secret parameters."""
    host = F.regexp_extract(url, r"^(?i)https?://([^/?#]+)", 1)
    port = F.regexp_extract(host, r":(\d*)$", 1)
    names = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1)))
    fine = (host != "") & ~url.rlike(r"\s") & ~host.contains("@") & ((port == "") | port.try_cast("int").between(1, 65535)) & ~F.exists(names, lambda n: n.isin(*SECRET_KEYS))
    return F.when(F.coalesce(fine, F.lit(False)), url)


# Parameters that name a page, in order of preference.
IDENTITY_KEYS = ("wlfareInfoId", "systId", "pbancSn", "panId", "pg", "nttId", "seq")


def url_identity(url: Column) -> Column:
    """kind:value of the first identifying parameter, else of a number in the path; null if there is none."""
    said = [F.when(v != "", F.concat(F.lit(f"{k}:"), v)) for k in IDENTITY_KEYS if (v := F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1)) is not None]
    path = F.regexp_extract(url, r"/ythPlcyDetail/([0-9]+)", 1)
    return F.coalesce(*said, F.when(path != "", F.concat(F.lit("plcyNo:"), path)))


def url_risks(urls: DataFrame, risky: tuple[str, ...], secrets: tuple[str, ...] = ()) -> DataFrame:
    """urls (url): one row with how many parameters are risky by name, are a plain navigation token, or an unsafe token."""
    host = F.regexp_extract("url", r"^(?i)https?://([^/?#:]+)", 1)
    pair = urls.select(host.alias("host"), F.explode(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: p != "")).alias("p"))
    name, value = F.lower(F.regexp_extract("p", "^([^=]*)", 1)), F.regexp_extract("p", "=(.*)$", 1)
    told = F.exists(F.array(*map(F.lit, secrets)).cast("array<string>"), lambda s: s.contains(value))
    public = F.lower("host").endswith(".go.kr") & value.rlike("^[0-9]{1,32}$") & ~told
    is_risky, is_token = name.isin(*risky), (name == "token") & ~name.isin(*risky)
    return pair.agg(F.count_if(is_risky).alias("high_risk"), F.count_if(is_token & public).alias("navigation_tokens"), F.count_if(is_token & ~public).alias("unsafe_tokens"))


def title_key(value: Column) -> Column:
    """ASCII letters and digits and Hangul, in lower case."""
    return F.lower(F.regexp_replace(value, "[^0-9A-Za-z가-힣]", ""))


def youth_marked(*texts: Column) -> Column:
    """Whether any of the texts names young people."""
    return F.concat_ws(" ", *texts).rlike("|".join(YOUTH))

