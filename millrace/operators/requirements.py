"""What a post asks for besides skills (place, pay, years, degrees), held against a profile.

A comparison is struct(state, note): match, partial, gap or unknown.  Facts of the posting come
first; a post without them is read by its labelled lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import text_or_empty
from . import keywords as kw

NEAR_KM, OPENING = 10, 800
LABELS = {"location": "location", "salary": "salary|compensation|remuneration|pay|package", "experience": "experience"}
DEGREE_LEVELS = ("bachelor's degree", "master's degree", "diploma", "ssc", "hsc")


def state(name: str, note: Column | str) -> Column:
    return F.struct(F.lit(name).alias("state"), (F.lit(note) if isinstance(note, str) else note).alias("note"))


def said(*parts: Column | str) -> Column:
    """Text of parts; numbers as they are."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def labelled_lines(segs: DataFrame) -> DataFrame:
    """(doc_id, location_line, salary_line, experience_line): the first line of each label."""
    label, rest = (F.trim(F.regexp_extract("segment", r"^([^:]{2,40}):\s*(.+)$", k)) for k in (1, 2))
    first = [F.min_by(F.when(label.rlike(rf"(?i)^({p})$"), rest), F.when(label.rlike(rf"(?i)^({p})$"), F.col("seg"))).alias(f"{name}_line") for name, p in LABELS.items()]
    return segs.groupBy("doc_id").agg(*first)


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``place`` struct(text, km, remote), ``pay`` struct(text, lo, hi) and ``asks`` (years, in
    words), each null where neither posting nor post says anything."""
    d = docs.join(labelled_lines(kw.segments(docs, text)), "doc_id", "left")
    c = lambda n, k="string": _column(docs, n, k)
    filled = lambda x: F.nullif(text_or_empty(x), F.lit(""))
    here = F.coalesce(filled(c("area")), filled(c("location")))
    place = F.when(here.isNotNull(), F.struct(here.alias("text"), c("distanceKm", "double").alias("km"), text_or_empty(c("employmentType")).rlike("(?i)remote").alias("remote")))
    place = place.when(F.col("location_line").isNotNull(), F.struct(F.col("location_line").alias("text"), F.lit(None).cast("double").alias("km"), F.col("location_line").rlike("(?i)remote").alias("remote")))
    low, high = c("salaryMin", "bigint"), c("salaryMax", "bigint")
    numbers = F.filter(F.transform(F.regexp_extract_all("salary_line", F.lit(r"[\d,]{3,}"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")), lambda n: n >= 1000)
    money = lambda t, a, b: F.struct(t.alias("text"), a.alias("lo"), b.alias("hi"))
    pay = F.when(low.isNotNull() | high.isNotNull() | filled(c("salaryText")).isNotNull(), money(text_or_empty(c("salaryText")), low, high))
    pay = pay.when(F.col("salary_line").isNotNull(), money(F.col("salary_line"), F.get(numbers, F.lit(0)), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0)))))
    opening = F.substring(text_or_empty(F.col(text)), 1, OPENING)  # where a post says it, without a label
    near = F.regexp_extract(F.concat_ws(" ", text_or_empty(c("title")), opening), fixed.YEARS, 0)
    asks = F.coalesce(filled(c("experienceText")), F.col("experience_line"), F.when(opening.rlike("(?i)fresher"), F.lit("Freshers welcome")), F.nullif(near, F.lit("")))
    return d.withColumns({"place": place, "pay": pay, "asks": asks}).drop(*[f"{k}_line" for k in LABELS])


def compare_place(place: Column, yours: list[str]) -> Column:
    """Remote fits; then the distance; then whether one of your places and the post's hold each other."""
    names = [kw.plain_norm(y).lower() for y in yours]
    text = F.lower(kw.norm(place["text"]))
    either = lambda n: F.contains(text, F.lit(n)) | F.contains(F.lit(n), text)
    listed = F.greatest(*[either(n) for n in names], F.lit(False)) if names else F.lit(False)
    km = place["km"]
    return (
        F.when(place.isNull(), F.lit(None))
        .when(place["remote"], state("match", "Remote work fits any place."))
        .when(km.isNotNull() & (km <= NEAR_KM), state("match", said(km, " km away.")))
        .when(km.isNotNull(), state("gap", said(km, f" km away, over {NEAR_KM} km.")))
        .when(listed, state("match", said("One of your places: ", ", ".join(yours), ".")))
        .otherwise(state("unknown", said("Not comparable with your places: ", ", ".join(yours) or "none set", ".")))
    )


def compare_years(asks: Column, have: float) -> Column:
    need = F.when(~asks.rlike(fixed.AGE), F.regexp_extract(asks, fixed.YEARS, 1).try_cast("int"))
    return (
        F.when(asks.isNull(), F.lit(None))
        .when(need.isNull() & asks.rlike("(?i)fresher"), state("match", "Freshers are welcome."))
        .when(need.isNull(), state("unknown", "No number of years is stated."))
        .when(need <= have, state("match", said("Asks for ", need, f" years; you have {have:g}.")))
        .otherwise(state("gap", said("Asks for ", need, f" years; you have {have:g}.")))
    )


def compare_pay(pay: Column, expected: int | None) -> Column:
    top = F.coalesce(pay["hi"], pay["lo"])
    out = F.when(pay.isNull(), F.lit(None))
    if not expected:
        return out.otherwise(state("unknown", "You have set no expected pay."))
    return (
        out.when(top.isNull(), state("unknown", said("No number: ", F.coalesce(F.nullif(pay["text"], F.lit("")), F.lit("not stated")), ".")))
        .when(top >= expected, state("match", said("Up to Tk ", F.format_number(top, 0), f" meets your Tk {expected:,}.")))
        .otherwise(state("gap", said("Up to Tk ", F.format_number(top, 0), f" is under your Tk {expected:,}.")))
    )


def compare_degrees(keywords: DataFrame) -> DataFrame:
    """(doc_id, degrees): of documents that name degrees.  A level alone does not meet a named
    field, nor a field another level; either is partial."""
    d = keywords.where("kind = 'degree'").withColumns({"lvl": F.col("key").isin(*DEGREE_LEVELS), "ok": F.col("evidence") == "skills"})
    names = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("rank", "display")))), lambda x: x["display"]), " / ")  # noqa: E731  a post's degrees
    g = d.groupBy("doc_id").agg(
        F.count_if("lvl").alias("levels"), F.count_if(~F.col("lvl")).alias("fields"), F.count_if(F.col("lvl") & F.col("ok")).alias("my_levels"), F.count_if(~F.col("lvl") & F.col("ok")).alias("my_fields"),
        names(F.col("lvl")).alias("n_levels"), names(~F.col("lvl")).alias("n_fields"), names(F.col("ok")).alias("n_mine"), names(F.lit(True)).alias("n_all"),
    )
    field, level = F.col("my_fields") > 0, F.col("my_levels") > 0
    out = (
        F.when((F.col("fields") == 0) & level, state("match", said("You have ", F.col("n_mine"), ".")))
        .when(field & ((F.col("levels") == 0) | level), state("match", said("You have ", F.col("n_mine"), ".")))
        .when(field, state("partial", said("The field fits, the level does not: ", F.col("n_levels"), ".")))
        .when(level & (F.col("fields") > 0), state("partial", said("The level fits, the field does not: ", F.col("n_fields"), ".")))
        .otherwise(state("gap", said("None of your degrees is ", F.col("n_all"), ".")))
    )
    return g.select("doc_id", out.alias("degrees"))


def panel(docs: DataFrame, keywords: DataFrame, lexicon: DataFrame, preferences: dict, text: str = "text") -> DataFrame:
    """One row a document: ``groups`` (name -> matched, total), ``duties`` (the first eight), and
    the comparisons ``degrees``, ``years``, ``place_fit`` and ``pay_fit``, with the facts.

    ``keywords``: ranked and with ``evidence``."""
    groups = kw.requirement_groups(keywords).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("grp_name", F.struct("matched", "total")))).alias("groups"))  # six
    duties = kw.responsibilities(docs, lexicon, text=text).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "segment"))), lambda x: x["segment"]).alias("duties"))  # eight
    d = facts(docs, text).join(groups, "doc_id", "left").join(duties, "doc_id", "left").join(compare_degrees(keywords), "doc_id", "left")
    return d.withColumns({"years": compare_years(F.col("asks"), float(preferences.get("experienceYears") or 0)), "place_fit": compare_place(F.col("place"), preferences.get("locations") or []), "pay_fit": compare_pay(F.col("pay"), int(preferences.get("expectedSalaryMin") or 0) or None)})
