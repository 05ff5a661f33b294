"""Everything for one application: needs and overlap, letter, mail, note, documents, report, checklist.

All of it is columns over postings; the profile is small and part of the plan as literals.  What
only a person can know stays a placeholder, ``[EDIT THIS: ...]``.  Nothing is sent.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.parse import percent
from ..functions.text import first_email, let, text_or_empty, word_count
from . import compose, keywords as kw
from .compose import listed

MOST_NEEDS, MOST_OVERLAP, MOST_GAPS, MOST_DUTIES = 3, 2, 12, 12
#: Words of an achievement and of a quoted duty, and whether the education is told, in the order tried.
STEPS = [(28, 16, True), (24, 14, True), (20, 12, True), (16, 10, True), (14, 8, False), (12, 6, False), (10, 0, False)]
EDIT = "[EDIT THIS"


def edit(what: str) -> str:
    return f"{EDIT}: {what}]"


def edits_left(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(r"\[EDIT THIS"))


def blank_to(c: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text_or_empty(c)), F.lit("")), F.lit(otherwise))


def company_of(c: Column) -> Column:
    """The company, blank where it is not known."""
    t = F.trim(text_or_empty(c))
    return F.when(t.rlike("(?i)^unknown company$"), "").otherwise(t)


def degree_field(degree: Column) -> Column:
    """What follows "in": the field of a degree, or the degree itself."""
    return F.trim(F.regexp_replace(text_or_empty(degree), r"(?i)^.*?\bin\s+", ""))


def education_label(degree: Column, date: Column, expected: Column) -> Column:
    """"X student (degree expected T)" while it is expected, "X graduate" after; blank without a degree."""
    name = F.coalesce(F.nullif(degree_field(degree), F.lit("")), degree)
    when = F.trim(F.regexp_replace(text_or_empty(date), "(?i)expected", ""))
    student = lambda t: F.concat(name, F.lit(" student"), F.when(t != "", F.concat(F.lit(" (degree expected "), t, F.lit(")"))).otherwise(""))
    return (
        F.when(text_or_empty(degree) == "", "")
        .when(text_or_empty(expected) != "", student(expected))
        .when(text_or_empty(date).rlike("(?i)expected"), student(when))
        .otherwise(F.concat(name, F.lit(" graduate")))
    )


def my_education(profile: dict[str, Any]) -> Column:
    first = next(iter(profile.get("education") or []), {})
    return education_label(*[F.lit(first.get(k)).cast("string") for k in ("degree", "date", "expectedGraduation")])


# -- decisions and keywords --------------------------------------------------------------------


def normalized_decisions(saved: DataFrame, value: str = "value") -> DataFrame:
    """Add ``enabled``, ``added`` and ``skipped`` to rows of saved JSON; older saves say ``claimed``
    and ``off``.  Only texts count, each once, and what is added is not skipped."""
    d = saved.withColumn("_v", F.try_parse_json(value))
    has = lambda k: F.expr(f"try_variant_get(_v, '$.{k}', 'variant')").isNotNull()
    strings = lambda k: F.array_distinct(F.filter(F.transform(F.expr(f"coalesce(try_variant_get(_v, '$.{k}', 'array<variant>'), array())"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull()))
    added = F.when(has("added"), strings("added")).otherwise(strings("claimed"))
    skipped = F.when(has("skipped"), strings("skipped")).otherwise(strings("off"))
    on = F.coalesce(F.expr("try_variant_get(_v, '$.enabled', 'boolean')"), F.lit(True))
    return d.withColumns({"enabled": on, "added": added, "skipped": F.array_except(skipped, added)}).drop("_v")


def chosen(keywords: DataFrame, decided: DataFrame) -> DataFrame:
    """Keywords with ``added``: those decided for, degrees never."""
    d = keywords.join(decided.select("doc_id", F.col("added").alias("_added")), "doc_id", "left")
    return d.withColumn("added", (F.col("kind") != "degree") & F.coalesce(F.array_contains("_added", F.col("key")), F.lit(False))).drop("_added")


def in_order(value: Column, when: Column | None = None) -> Column:
    """A document's values by rank."""
    item = F.struct("rank", value.alias("x"))
    return F.transform(F.array_sort(F.collect_list(item if when is None else F.when(when, item))), lambda x: x["x"])


def needs(keywords: DataFrame) -> DataFrame:
    """(doc_id, needs, overlap, mine): what the post needs most (three: listed skills, then soft
    ones, then mined terms), which of these you have (two), and all that you have."""
    k = keywords.where("kind <> 'degree'").withColumn("own", F.col("added") | (F.col("evidence") == "skills"))
    bucket = F.when(F.col("source") != "lexicon", 2).when(F.col("kind") == "soft", 1).otherwise(0)
    wanted = F.col("tier").isin("must", "important")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(wanted, bucket).otherwise(3), "rank"))
    k = k.withColumn("_n", place).withColumn("need", wanted & (F.col("_n") <= MOST_NEEDS))
    by_place = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("_n", "display")))), lambda x: x["display"])
    return k.groupBy("doc_id").agg(by_place(F.col("need")).alias("needs"), F.slice(by_place(F.col("need") & F.col("own")), 1, MOST_OVERLAP).alias("overlap"), in_order(F.col("display"), F.col("own")).alias("mine"), F.bool_or(F.col("key") == "multitasking").alias("_multi"))  # one post's keywords


def patterns(keywords: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Keywords with ``pattern``: any wording of the entry, or a mined term's own."""
    every = lexicon.groupBy("key").agg(F.array_join(F.collect_list("any_case"), "|").alias("_p"))  # an entry's wordings
    return keywords.join(every, "key", "left").withColumn("pattern", F.coalesce("_p", kw.whole_word(F.col("display")))).drop("_p")


def candidate_bullets(profile: dict[str, Any]) -> list[dict[str, Any]]:
    """The profile's bullets with where they come from; those of experience count one more."""
    own = [dict(text=str(b).strip(), kind="experience", role=x.get("role") or "", firm=x.get("company") or "", bonus=1) for x in profile.get("experience") or [] for b in x.get("bullets") or []]
    own += [dict(text=str(b).strip(), kind="project", role="", firm=x.get("name") or "", bonus=0) for x in profile.get("projects") or [] for b in x.get("bullets") or []]
    return [b | {"ord": i} for i, b in enumerate(b for b in own if b["text"])]


def achievements(docs: DataFrame, matched: DataFrame, bullets: list[dict[str, Any]], n: int = 2, experience_only: Column | None = None) -> DataFrame:
    """Add ``picked`` (the ``n`` best bullets) and ``n_matched``.  A bullet scores three for each of
    the post's keywords, two more where it is added, and its bonus; without enough that hold a
    keyword, the best of experience follow.  ``matched``: keywords with ``pattern`` and ``added``."""
    kind = "array<struct<ord int, text string, kind string, role string, firm string, bonus int, hits bigint, score bigint>>"
    if not bullets:
        return docs.withColumns({"picked": F.array().cast(kind), "n_matched": F.lit(0)})
    lits = F.array(*[F.struct(*[F.lit(b[k]).alias(k) for k in ("ord", "text", "kind", "role", "firm", "bonus")], F.lit(kw.plain_norm(b["text"])).alias("norm")) for b in bullets])
    held = F.transform(F.filter(lits, lambda b: F.rlike(b["norm"], F.col("pattern"))), lambda b: b["ord"])
    hits = matched.where("kind <> 'degree'").select("doc_id", F.col("added").cast("int").alias("a"), F.explode(held).alias("ord"))
    hits = hits.groupBy("doc_id", "ord").agg(F.count("*").alias("hits"), F.sum("a").alias("extra"))
    hits = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", F.struct("hits", "extra")))).alias("_h"))  # a profile's bullets
    got = lambda b, k: F.coalesce(F.try_element_at("_h", b["ord"])[k], F.lit(0).cast("bigint"))
    scored = F.transform(lits, lambda b: F.struct((-(got(b, "hits") * 3 + got(b, "extra") * 2 + b["bonus"])).alias("low"), *[b[k].alias(k) for k in ("ord", "text", "kind", "role", "firm", "bonus")], got(b, "hits").alias("hits")))
    ranked = F.transform(F.array_sort(scored), lambda b: F.struct(*[b[k].alias(k) for k in ("ord", "text", "kind", "role", "firm", "bonus", "hits")], (-b["low"]).alias("score")))
    held_jobs = sum(b["kind"] == "experience" for b in bullets)
    if experience_only is not None and held_jobs >= n:
        ranked = F.when(experience_only, F.filter(ranked, lambda b: b["kind"] == "experience")).otherwise(ranked)
    d = docs.join(hits, "doc_id", "left").withColumn("_r", ranked)
    best = F.slice(F.filter("_r", lambda b: b["hits"] > 0), 1, n)
    rest = F.filter("_r", lambda b: (b["kind"] == "experience") & ~F.exists(best, lambda x: x["ord"] == b["ord"]))
    return d.withColumns({"picked": F.slice(F.concat(best, rest), 1, n), "n_matched": F.size(best)}).drop("_h", "_r")


def context_of(picked: Column) -> Column:
    """Where the examples come from: one role, one project, or the resume."""
    first = F.get(picked, F.lit(0))
    same = F.forall(picked, lambda b: (b["kind"] == first["kind"]) & (b["role"] == first["role"]) & (b["firm"] == first["firm"]))
    firm = F.regexp_replace(first["firm"], r"\.+$", "")
    role = F.when((first["role"] != "") & (firm != ""), F.concat(F.lit("my "), first["role"], F.lit(" role at "), firm)).when(first["role"] != "", F.concat(F.lit("my "), first["role"], F.lit(" role"))).when(firm != "", F.concat(F.lit("my work at "), firm))
    project = F.when(firm != "", F.concat(F.lit("my "), firm, F.lit(" project")))
    return F.coalesce(F.when((F.size(picked) > 0) & same, F.when(first["kind"] == "experience", role).otherwise(project)), F.lit("my resume"))


def clip_words(c: Column, n: int) -> Column:
    """At most ``n`` words, cut at a clause where one ends in the second half; never reworded."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")), r"[.;:,\s]+$", "")
    words = F.split(t, " ")
    head = F.array_join(F.slice(words, 1, n), " ")
    clause = F.regexp_extract(head, rf"^(.*)(?:{fixed.CLAUSE_ENDS})", 1)
    cut = F.regexp_replace(F.when(F.length(clause) * 2 > F.length(head), clause).otherwise(head), r"[\s,;:]+$", "")
    return F.when(F.size(words) <= n, t).otherwise(F.trim(F.regexp_replace(cut, rf"(?i)(\s+({fixed.TAIL_WORDS})){{1,3}}$", "")))


def duties(docs: DataFrame, matched: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, duty, duty_hits): the duty line that holds most of what you have, the first of equals;
    lines that praise the company are left out."""
    lines = kw.responsibilities(docs, lexicon, MOST_DUTIES, text).join(docs.select("doc_id", F.lower(kw.norm(company_of(F.col("company")))).alias("_firm")), "doc_id")
    blurb = ((F.col("_firm") != "") & F.contains(F.lower(kw.norm(F.col("segment"))), F.col("_firm"))) | F.col("segment").rlike(fixed.BLURB)
    mine = matched.where("kind <> 'degree' AND (added OR evidence = 'skills')").select("doc_id", "pattern")
    held = lines.where(~blurb).join(mine, "doc_id", "left").withColumn("_hit", F.coalesce(F.rlike(kw.norm(F.col("segment")), F.col("pattern")), F.lit(False)))
    held = held.groupBy("doc_id", "n", "segment").agg(F.count_if("_hit").alias("hits"))
    return held.groupBy("doc_id").agg(F.max_by("segment", F.struct("hits", -F.col("n"))).alias("duty"), F.max("hits").alias("duty_hits"))


# -- texts ----------------------------------------------------------------------------------------


def body_words(letter: Column) -> Column:
    """Words of a letter between greeting and farewell."""
    t = F.regexp_replace(F.replace(text_or_empty(letter), F.lit("\r"), F.lit("")), r"(?i)\A\s*Dear[^\n]*\n+", "")
    return word_count(F.regexp_replace(t, fixed.FAREWELL, ""))


def letter(profile: dict[str, Any]) -> Column:
    """struct(text, body, words, in_range, notes): three paragraphs, shortened through STEPS until
    they have 180 words at most.  Needs title, company, needs, overlap, mine, picked, n_matched,
    duty, duty_hits and ``multi``."""
    firm, role, edu = company_of(F.col("company")), blank_to(F.col("title"), edit("role")), my_education(profile)
    several = lambda a, one, more: F.when(F.size(a) > 1, F.lit(more)).otherwise(F.lit(one))

    def build(clip: int, quote: int, tell: bool) -> Column:
        first = F.concat_ws(
            " ", F.concat(F.lit("I would like to apply for the "), role, F.lit(" position at "), blank_to(firm, edit("company")), F.lit(".")),
            F.when(edu != "", F.concat(F.lit("I am a "), edu, F.lit("."))) if tell else F.lit(None).cast("string"),
            F.when(F.size("needs") > 0, F.concat(F.lit("What you ask for most "), several("needs", "is ", "are "), listed(F.col("needs")), F.lit("."))).otherwise(edit("what this role needs most") + "."),
            F.when(F.size("overlap") > 0, F.concat(listed(F.col("overlap")), several("overlap", " is", " are"), F.lit(" part of what I do already.")))
            .when((F.size("mine") > 0) & (F.size("needs") > 0), F.concat(F.lit("What I can show today is "), listed(F.slice("mine", 1, 2)), F.lit(".")))
            .when(F.size("needs") > 0, edit("the requirement that you can speak to") + "."),
        )
        shown = F.transform("picked", lambda b: compose.lower_first(clip_words(b["text"], clip)))
        where = context_of(F.col("picked"))
        lead = F.when(F.col("multi") & F.exists("picked", lambda b: b["kind"] == "experience"), F.concat(F.lit("As for many tasks at once, from "), where, F.lit(": "))).otherwise(F.concat(several("picked", "An example from ", "Two examples from "), where, F.lit(": ")))
        second = F.when(F.size("picked") == 0, edit("two achievements that match this post") + ".").otherwise(F.concat(lead, F.array_join(shown, "; and "), F.lit(".")))
        third = F.concat_ws(
            " ", F.when(F.col("duty_hits") > 0, F.concat(F.lit('Of the duties you list, I am closest to "'), clip_words(F.col("duty"), quote), F.lit('".'))) if quote else F.lit(None).cast("string"),
            F.concat(F.lit(f"{EDIT}: what draws you to "), blank_to(firm, "the company"), F.lit(", from what you looked up].")), F.lit("I would be glad to talk about how I can help."),
        )
        return F.concat_ws("\n\n", first, second, third)

    body = compose.first_within([build(*s) for s in STEPS], lambda c: word_count(c) <= compose.MOST_LETTER_WORDS)
    person = profile.get("personal") or {}
    contact = " | ".join(x for x in (person.get("phone"), person.get("email")) if x)
    sign = f"\n\nSincerely,\n{(person.get('fullName') or '').strip() or edit('your name')}" + (f"\n{contact}" if contact else "")

    def whole(b: Column) -> Column:
        n = word_count(b)
        notes = F.array_compact(F.array(
            F.when(n < compose.LEAST_LETTER_WORDS, F.concat(F.lit("Short ("), n.cast("string"), F.lit(" words): nothing was added to fill it."))), F.when(n > compose.MOST_LETTER_WORDS, F.concat(F.lit("Long ("), n.cast("string"), F.lit(" words) even when shortened."))),
            F.when((F.size("picked") > 0) & (F.col("n_matched") < F.least(F.lit(2), F.size("picked"))), F.lit("Some examples are general ones.")),
        ))
        hello = F.concat(F.lit("Dear "), F.when(firm != "", F.concat(firm, F.lit(" "))).otherwise(""), F.lit("Hiring Team,\n\n"))
        return F.struct(F.concat(hello, b, F.lit(sign)).alias("text"), b.alias("body"), n.alias("words"), n.between(compose.LEAST_LETTER_WORDS, compose.MOST_LETTER_WORDS).alias("in_range"), notes.alias("notes"))

    return let(body, whole)


def mail_draft(profile: dict[str, Any], text: str = "text") -> Column:
    """struct(to, subject, body, text, words).  Needs title, company, overlap, file, asks_letter and the post."""
    person, edu = profile.get("personal") or {}, my_education(profile)
    name = (person.get("fullName") or "").strip() or edit("your name")
    contact = " | ".join(x for x in (person.get("phone"), person.get("email")) if x)
    firm, role = company_of(F.col("company")), blank_to(F.col("title"), edit("role"))
    to = F.coalesce(F.nullif(first_email(F.col(text)), F.lit("")), F.lit(edit("recipient from the post")))
    subject = F.concat(F.lit("Application for "), role, F.lit(f" - {name}"))
    attached = F.concat(F.when(F.col("asks_letter"), "My resume and cover letter are attached").otherwise("My resume is attached"), F.coalesce(F.concat(F.lit(" ("), F.nullif("file", F.lit("")), F.lit(")")), F.lit("")), F.lit("."))
    about = F.when(edu != "", F.concat(F.lit("I am a "), edu, F.when(F.size("overlap") > 0, F.concat(F.lit("; your post and my work meet most in "), listed(F.col("overlap")))).otherwise(""), F.lit(".")))
    body = F.concat_ws("\n\n", F.lit("Dear Hiring Team,"), F.concat(F.lit("I am applying for the "), role, F.lit(" position"), F.when(firm != "", F.concat(F.lit(" at "), firm)).otherwise(""), F.lit(". "), attached), about, F.lit("I can come for an interview when it suits you." + (f" I can be reached at {contact}." if contact else "")), F.lit(f"Best regards,\n{name}"))
    return let(F.struct(to.alias("to"), subject.alias("subject"), body.alias("body")), lambda m: F.struct(m["to"].alias("to"), m["subject"].alias("subject"), m["body"].alias("body"), F.concat(F.lit("To: "), m["to"], F.lit("\nSubject: "), m["subject"], F.lit("\n\n"), m["body"]).alias("text"), word_count(m["body"]).alias("words")))


def recruiter_note(profile: dict[str, Any]) -> Column:
    """The fullest of four notes within 300 characters; title and company are kept whole as far as 60
    and 50 characters go."""
    firm, role = compose.clip_chars(blank_to(company_of(F.col("company")), "the company"), 50), compose.clip_chars(blank_to(F.col("title"), "open"), 60)
    job, edu = next(iter(profile.get("experience") or []), {}).get("role") or "", my_education(profile)
    head = F.concat(F.lit(f"Hi {edit('name')}, I have applied for the "), role, F.lit(" role at "), firm, F.lit("."))
    me = F.when(edu != "", F.concat(F.lit("I am a "), edu))
    held = F.lit(f"I have worked as {'an' if job[:1].lower() in 'aeiou' else 'a'} {job}" if job else None).cast("string")
    meet = F.when(F.size("overlap") > 0, F.concat(F.lit("we meet most in "), listed(F.col("overlap"))))
    none = F.lit(None).cast("string")
    make = lambda *bits: F.concat(head, let(F.array_join(F.array_compact(F.array(*bits)), "; "), lambda b: F.when(b != "", F.concat(F.lit(" "), b, F.lit("."))).otherwise("")), F.lit(" I am happy to send my resume."))
    notes = [make(me, held, meet), make(me, meet), make(me), make(none)]
    return F.substring(compose.first_within(notes, lambda c: F.length(c) <= compose.MOST_NOTE_CHARS), 1, compose.MOST_NOTE_CHARS)


def required_documents(text: Column) -> Column:
    """Documents (key, name, from_post) a post asks for; the resume always."""
    hits = F.array(*[text_or_empty(text).rlike(f"(?i){p}") for _, _, p in fixed.DOCUMENTS])  # each pattern once

    def named(hit: Column) -> Column:
        one = lambda i, k, n: F.when(F.lit(k == "cv") | hit[i], F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), hit[i].alias("from_post")))
        return F.array_compact(F.array(*[one(i, k, n) for i, (k, n, _) in enumerate(fixed.DOCUMENTS)]))

    return let(hits, named)


def report(keywords: DataFrame, panel: DataFrame, before: DataFrame, now: DataFrame, years: float) -> DataFrame:
    """(doc_id, added, gaps, match_before, match_after): what was added, the first twelve gaps
    (keywords by rank, then degrees, years, place and pay), and coverage in per cent."""
    k = keywords.where("kind <> 'degree'")
    asks = F.col("tier").isin("must", "important")
    lacks = asks & (F.col("evidence") != "skills") & ~F.col("added")
    short = asks & ~lacks & F.col("hardRequirement") & (F.col("yearsRequired") > years)
    asked = F.when(F.col("hardRequirement"), F.concat(F.lit(" ("), F.col("yearsRequired").cast("string"), F.lit(" years)"))).otherwise("")
    gap = F.when(lacks, F.concat(F.col("display"), asked, F.lit(": not in your profile"))).when(short, F.concat(F.col("display"), F.lit(": "), F.col("yearsRequired").cast("string"), F.lit(f" years asked, {years:g} stated")))
    own = k.groupBy("doc_id").agg(in_order(F.col("display"), F.col("added")).alias("added"), in_order(gap, gap.isNotNull()).alias("_gaps"))  # one post's keywords
    named = (("Education", "degrees"), ("Experience", "years"), ("Location", "place_fit"), ("Salary", "pay_fit"))
    more = F.array_compact(F.array(*[F.when(F.col(f"{c}.state").isin("gap", "partial"), F.concat(F.lit(f"{n}: "), F.col(f"{c}.note"))) for n, c in named]))
    rate = lambda d, name: d.select("doc_id", percent(F.col("found"), F.col("total")).alias(name))
    out = panel.join(own, "doc_id", "left").join(rate(before, "match_before"), "doc_id", "left").join(rate(now, "match_after"), "doc_id", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.coalesce("added", none).alias("added"), F.slice(F.concat(F.coalesce("_gaps", none), more), 1, MOST_GAPS).alias("gaps"), F.coalesce("match_before", F.lit(0)).alias("match_before"), F.coalesce("match_after", F.lit(0)).alias("match_after"))


def checklist(today: Column) -> Column:
    """Tasks struct(key, state, note) of a pack, in order: done, todo, info or warn.  Needs file,
    asks_letter, letter, mail, note, url, apply_to, deadline and documents."""
    task = lambda key, st, note: F.struct(F.lit(key).alias("key"), st.alias("state"), note.alias("note"))
    lit, left = F.lit, edits_left
    many = lambda n: F.concat(n.cast("string"), F.lit(" placeholders left"))
    ready = lambda key, c: task(key, F.when(left(c) > 0, "todo").otherwise("done"), F.when(left(c) > 0, many(left(c))).otherwise("ready"))
    cover = F.col("letter.text")
    link, mail = text_or_empty(F.col("url")), text_or_empty(F.col("apply_to"))
    days = F.date_diff(F.col("deadline"), today)
    extra = F.transform(F.filter("documents", lambda d: (d["key"] != "cv") & d["from_post"]), lambda d: d["name"])
    total = left(cover) + left(F.col("mail.text")) + left(F.col("note"))
    return F.array(
        task("resume", lit("done"), F.concat(lit("Save as "), F.col("file"))),
        task("cover", F.when(~F.col("asks_letter"), "info").when(left(cover) > 0, "todo").otherwise("done"), F.when(~F.col("asks_letter"), "not asked for").when(left(cover) > 0, many(left(cover))).otherwise("ready")),
        ready("email", F.col("mail.text")), ready("recruiter", F.col("note")),
        task("url", F.when((link == "") & (mail == ""), "warn").otherwise("info"), F.when(link != "", link).when(mail != "", F.concat(lit("by mail to "), mail)).otherwise("neither link nor address is given")),
        task("deadline", F.when(days < 0, "warn").otherwise("info"), F.when(days.isNull(), "not stated").when(days < 0, "has passed").otherwise(F.concat(days.cast("string"), F.when(days == 1, " day left").otherwise(" days left")))),
        task("docs", F.when(F.size(extra) > 0, "todo").otherwise("info"), F.when(F.size(extra) > 0, F.array_join(extra, ", ")).otherwise("none beyond the resume")),
        task("placeholders", F.when(total > 0, "todo").otherwise("done"), F.when(total > 0, many(total)).otherwise("none left")),
    )


def rank_experience(experience: list[dict[str, Any]], keywords: list[str]) -> list[dict[str, Any]]:
    """A profile's jobs, those with most of the keywords first; ties keep their order."""
    import re

    found = [kw.phrase_pattern(k) for k in keywords]
    text = lambda x: kw.plain_norm(" ".join([x.get("role") or "", *(x.get("bullets") or []), *(x.get("tags") or [])]))
    return sorted(experience, key=lambda x: -sum(bool(re.search(p, text(x))) for p in found))


def build(docs: DataFrame, keywords: DataFrame, lexicon: DataFrame, profile: dict[str, Any], as_of: Column, resume: str = "", text: str = "text") -> DataFrame:
    """The whole pack of each posting: file, documents, asks_letter, apply_to, letter, mail, note, pay
    (state, amount), the panel's comparisons, the report and the checklist.

    ``docs``: doc_id, title, company, url, deadline and the post, with what is known of its place and
    pay; ``keywords``: all of :func:`mining.extract_all`, with ``evidence`` and ``added``."""
    from .requirements import panel as compare

    prefs = profile.get("preferences") or {}
    matched = patterns(keywords, lexicon)
    d = compare(docs, keywords, lexicon, prefs, text)
    d = d.join(needs(keywords), "doc_id", "left").join(duties(docs, matched, lexicon, text), "doc_id", "left")
    none = F.array().cast("array<string>")
    d = d.withColumns({c: F.coalesce(c, none) for c in ("needs", "overlap", "mine")} | {"multi": F.coalesce("_multi", F.lit(False)) | text_or_empty(F.col(text)).rlike(fixed.MULTITASK), "duty_hits": F.coalesce("duty_hits", F.lit(0))})
    d = achievements(d, matched, candidate_bullets(profile), experience_only=F.col("multi"))
    d = d.withColumns({"documents": required_documents(F.col(text)), "file": compose.file_name(company_of(F.col("company")), F.col("title"), as_of), "apply_to": F.nullif(first_email(F.col(text)), F.lit(""))})
    d = d.withColumn("asks_letter", F.exists("documents", lambda x: (x["key"] == "cover") & x["from_post"]))
    expected = F.lit(int(prefs.get("expectedSalaryMin") or 0) or None).cast("bigint")
    d = d.withColumns({"letter": letter(profile), "mail": mail_draft(profile, text), "note": recruiter_note(profile), "ask": kw.suggest_salary(F.col("pay.lo"), F.col("pay.hi"), expected)})
    added = keywords.where("added")
    told = report(keywords, d, kw.coverage(keywords, resume), covered_with(keywords, added, resume), float(prefs.get("experienceYears") or 0))
    d = d.drop("added").join(told, "doc_id", "left").withColumn("checklist", checklist(as_of))
    return d.drop("_multi", "multi")


def covered_with(keywords: DataFrame, added: DataFrame, resume: str) -> DataFrame:
    """Coverage once the added keywords stand in the resume too."""
    mine = added.select("doc_id", "key", F.lit(True).alias("_in"))
    k = keywords.where("kind <> 'degree'").join(mine, ["doc_id", "key"], "left")
    hit = F.coalesce("_in", F.rlike(F.lit(kw.plain_norm(resume)), kw.whole_word(F.col("display"))))
    return k.groupBy("doc_id").agg(F.count_if(hit).alias("found"), F.count("*").alias("total"))
