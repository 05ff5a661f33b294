"""Column functions that read money, dates, years of experience and places out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import clean_ws, let, normalize_title, slug, text_or_empty, words

_NUM = r"(\d[\d,\.]*)"
_CUR, _UNIT = rf"(?:{fixed.CURRENCY})", rf"({fixed.UNIT})?"
_AFTER = r"(?:(?:tk|bdt|taka)\b|৳)"
RANGE = rf"(?i)(?:{_CUR})?\.?\s*{_NUM}\s*{_UNIT}\s*{_AFTER}?\s*(?:-|to|–|—)\s*(?:{_CUR})?\.?\s*{_NUM}\s*{_UNIT}"
PREFIXED = rf"(?i){_CUR}\.?\s*{_NUM}\s*{_UNIT}"
SUFFIXED = rf"(?i){_NUM}\s*{_UNIT}\s*{_AFTER}"


def amount(number: Column, unit: Column) -> Column:
    """Digits and unit to whole currency; under 1000 counts as thousands; halves to even."""
    u = F.lower(text_or_empty(unit))
    times = F.when(u.isin("k", "thousand"), 1000).when(u.isin("lakh", "lac"), 100000).otherwise(1)
    return let(F.translate(number, ",", "").try_cast("double") * times, lambda v: F.bround(F.when(v < 1000, v * 1000).otherwise(v), 0).cast("int"))


def parse_salary(c: Column) -> Column:
    """struct(lo int, hi int, text): a range, else one amount with currency, else "Negotiable", else blank."""
    none = F.lit(None).cast("int")
    money = lambda x: F.format_number(x, 0)
    out = lambda x, y, s: F.struct(x.alias("lo"), y.alias("hi"), s.alias("text"))

    def ordered(v: Column) -> Column:
        a, b = v["a"], v["b"]
        both = (a != 0) & (b != 0)
        return F.struct(F.when(both, F.least(a, b)).otherwise(a).alias("lo"), F.when(both, F.greatest(a, b)).otherwise(b).alias("hi"))

    def choose(v: Column) -> Column:
        r = v["r"]
        ranged = F.concat(F.lit("Tk "), money(r["lo"]), F.when(r["hi"] != 0, F.concat(F.lit(" - "), money(r["hi"]))).otherwise(""))
        single = lambda x: out(x, none, F.concat(F.lit("Tk "), money(x)))
        return (
            F.when(r["lo"] != 0, out(r["lo"], r["hi"], ranged))
            .when(v["p"] != 0, single(v["p"]))
            .when(v["s"] != 0, single(v["s"]))
            .when(v["t"].rlike(f"(?i){fixed.NEGOTIABLE}"), out(none, none, F.lit("Negotiable")))
            .otherwise(out(none, none, F.lit("")))
        )

    def found(t: Column) -> Column:
        at = lambda p, k: amount(F.regexp_extract(t, p, k), F.regexp_extract(t, p, k + 1))  # noqa: E731  no match: null
        both = let(F.struct(at(RANGE, 1).alias("a"), at(RANGE, 3).alias("b")), ordered)
        return let(F.struct(t.alias("t"), both.alias("r"), at(PREFIXED, 1).alias("p"), at(SUFFIXED, 1).alias("s")), choose)

    return let(clean_ws(c), found)


def pay_text(c: Column) -> Column:
    """The first three lines that speak of pay, 300 characters of each, in one line."""
    lines = F.filter(F.split(text_or_empty(c), "\n"), lambda x: x.rlike(f"(?i){fixed.PAY_HINT}"))
    return F.array_join(F.slice(F.transform(lines, lambda x: F.substring(x, 1, 300)), 1, 3), " ")


def monthly_pay(value: Column, unit: Column, currency: Column, home: str = "BDT") -> Column:
    """Stated pay as a monthly whole number: years by twelve, months as they are, else null; 0 is not
    stated.  A currency that is not stated is the home one."""
    u = F.upper(text_or_empty(unit))
    v = F.when(u == "YEAR", value / 12).when(u.isin("MONTH", ""), value)
    return F.when(F.upper(text_or_empty(currency)).isin(home, "") & (v != 0), F.bround(v, 0).cast("int"))


def parse_date(c: Column, as_of: Column) -> Column:
    """Date in any of the known formats, or relative to ``as_of``; null where none fits."""
    ago = r"(?i)(\d+)\s*(day|days|hour|hours|week|weeks)\s*ago"
    loose = r"(\d{1,2})[\s/-]([A-Za-z]{3,9}|\d{1,2})[\s/-](\d{4})"
    first = lambda v, formats: F.coalesce(*[F.to_date(F.try_to_timestamp(v, F.lit(f))) for f in formats])

    def read(t: Column) -> Column:
        n, unit = F.regexp_extract(t, ago, 1).try_cast("int"), F.lower(F.regexp_extract(t, ago, 2))
        days = F.when(unit.startswith("day"), n).when(unit.startswith("hour"), F.lit(0)).otherwise(n * 7)
        head = F.initcap(F.lower(F.trim(F.substring(t, 1, 40))))
        head = F.regexp_replace(head, "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
        head = F.regexp_replace(head, "^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})t([0-9:]+)(z?)", "$1T$2$3")
        found = F.initcap(F.lower(F.concat_ws(" ", *[F.regexp_extract(t, loose, k) for k in (1, 2, 3)])))
        dated = F.coalesce(let(head, lambda v: first(v, fixed.DATE_FORMATS)), let(found, lambda v: first(v, ("d MMM yyyy", "d MMMM yyyy", "d M yyyy"))))
        return F.when(t.rlike(ago), F.date_sub(as_of, days)).when(t.rlike(r"(?i)\btoday\b"), as_of).otherwise(dated)

    return let(F.trim(F.replace(F.replace(clean_ws(c), F.lit("Deadline:"), F.lit("")), F.lit("Published:"), F.lit(""))), read)


def years_required(c: Column) -> Column:
    """First number of years in text, null where there is none."""
    return F.regexp_extract(text_or_empty(c), fixed.YEARS, 1).try_cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, to one decimal."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(F.lit(2 * fixed.EARTH_KM) * F.asin(F.sqrt(h)), 1)


def resolve_area(location: Column, description: Column, areas: dict = fixed.AREAS, home: tuple = fixed.HOME) -> Column:
    """struct(area, km, remote): the longest place name in the location, else in the start of the
    description, else remote work, else the capital alone, else blank."""
    order = sorted(areas, key=len, reverse=True)
    names = F.array(*map(F.lit, order))
    lat = F.create_map(*[x for n in order for x in (F.lit(n), F.lit(areas[n][0]))])
    lon = F.create_map(*[x for n in order for x in (F.lit(n), F.lit(areas[n][1]))])
    start = F.substring(text_or_empty(description), 1, 600)
    hay = F.concat(F.lit(" "), slug(location), F.lit(" "))
    hay2 = F.concat(F.lit(" "), slug(start), F.lit(" "))
    first = lambda h: F.get(F.filter(names, lambda n: F.contains(h, F.concat(F.lit(" "), n, F.lit(" ")))), F.lit(0))
    remote = F.concat_ws(" ", text_or_empty(location), start).rlike(rf"(?i)\b({fixed.REMOTE})\b")

    def build(v: Column) -> Column:
        name = v["name"]
        km = haversine_km(F.lit(home[0]), F.lit(home[1]), F.try_element_at(lat, name), F.try_element_at(lon, name))
        area = F.when(name.isNotNull(), F.initcap(name)).when(v["remote"], F.lit("Remote")).when(v["capital"], F.lit("Dhaka (area not stated)")).otherwise("")
        return F.struct(area.alias("area"), F.when(name.isNotNull(), km).when(v["remote"], F.lit(0.0)).alias("km"), v["remote"].alias("remote"))

    name = F.coalesce(let(hay, first), let(hay2, first))
    return let(F.struct(name.alias("name"), remote.alias("remote"), F.contains(hay, F.lit("dhaka")).alias("capital")), build)


def foreign_country(location: Column) -> Column:
    """The country a location names when it is clearly not the home country, else null."""
    found = F.regexp_extract(text_or_empty(location), rf"(?i)\b({fixed.ABROAD})\b", 1)
    name = F.when(F.length(found) <= 3, F.upper(found)).otherwise(F.initcap(found))
    return F.when(~text_or_empty(location).rlike(rf"(?i)\b({fixed.HOME_COUNTRY})\b") & (found != ""), name)


def infer_category(title: Column, description: Column, rules: list = fixed.CATEGORY_RULES, default: str = fixed.DEFAULT_CATEGORY) -> Column:
    """Ordered keyword rules: a key in the title counts three times; the first of equal sums wins."""
    hay = F.concat(F.lit(" "), normalize_title(title), F.lit(" "))
    body = F.concat(F.lit(" "), F.substring(slug(description), 1, 4000), F.lit(" "))

    def points(h: Column, b: Column, keys: list[str], weight: int) -> Column:
        def one(k: str) -> Column:
            in_title = F.contains(h, F.lit(f" {k} "))
            if len(k) > 4:
                in_title = in_title | F.startswith(F.trim(h), F.lit(k))
            return F.when(in_title, 3 * weight).when(F.contains(b, F.lit(f" {k} " if len(k) <= 4 else f" {k}")), weight).otherwise(0)

        total = F.lit(0)
        for k in keys:
            total = total + one(k)
        return total

    def best(x: Column) -> Column:  # the two texts are made once, as fields of a lambda's variable
        scored = F.array(*[F.struct(points(x["h"], x["b"], keys, weight).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, weight, keys) in enumerate(rules)])
        top = F.array_max(scored)
        return F.when(top["score"] > 0, top["name"]).otherwise(default)

    return F.transform(F.array(F.struct(hay.alias("h"), body.alias("b"))), best)[0]


def is_relevant(title: Column, queries: list[str], spark_normalize=normalize_title) -> Column:
    """Every word of some query is in the title; or, without words of seniority, of a query that keeps two."""
    exact, loose = F.split(spark_normalize(title), " "), F.split(spark_normalize(title, True), " ")
    out = F.lit(False)
    for q in queries:
        need, need_loose = (F.array_distinct(F.filter(F.split(spark_normalize(F.lit(q), d), " "), lambda w: w != "")) for d in (False, True))
        out = out | ((F.size(need) > 0) & (F.size(F.array_except(need, exact)) == 0)) | ((F.size(need_loose) >= 2) & (F.size(F.array_except(need_loose, loose)) == 0))
    return out


def percent(found: Column, total: Column) -> Column:
    """Whole per cent, halves up; 0 of nothing."""
    return F.when(total > 0, F.floor(100.0 * found / total + 0.5)).otherwise(0).cast("int")


def title_fit(title: Column, targets: list[list[str]]) -> Column:
    """Best share, in whole per cent, of a target's words (short forms written out) in the title."""
    have = words(title, True)
    fits = [(F.lit(200) * F.size(F.filter(F.array(*map(F.lit, w)), lambda x: F.array_contains(have, x))) + len(w)).cast("bigint") for w in targets if w]
    return F.greatest(F.lit(0), *[F.expr("0") + F.floor(f / (2 * len(w))) for f, w in zip(fits, [w for w in targets if w], strict=True)], F.lit(0)).cast("int")


def level_fit(title: Column, experience: Column, description: Column, years: int) -> Column:
    """10 for senior titles, 100 for junior ones or freshers, else by the gap of years; 65 unknown."""
    need = F.coalesce(years_required(experience), years_required(title), years_required(F.substring(text_or_empty(description), 1, 800)))
    gap = F.greatest(F.lit(0), need - years)
    by_gap = F.when(gap < 4, F.element_at(F.array(*map(F.lit, (100, 80, 55, 30))), (F.least(gap, F.lit(3)) + 1).cast("int"))).otherwise(10)
    t = text_or_empty(title)
    return (
        F.when(t.rlike(rf"(?i)\b({fixed.SENIOR_TITLE})\b"), 10)
        .when(t.rlike(rf"(?i)\b({fixed.JUNIOR_TITLE})\b") | text_or_empty(experience).rlike("(?i)fresher"), 100)
        .when(need.isNull(), 65)
        .otherwise(by_gap)
    )
