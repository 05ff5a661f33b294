"""Composed texts keep their limits."""

import datetime

from pyspark.sql import functions as F

from millrace.operators import compose


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_names_and_lists(spark):
    day = F.lit(datetime.date(2026, 9, 24))
    r = one(spark, compose.file_name(F.lit("Quux Ltd."), F.lit("QA Engineer"), day), compose.file_name(F.lit(""), F.lit(None).cast("string"), day), compose.file_slug(F.lit("Ünïcode & Co."), "x"), compose.listed(F.array(*map(F.lit, "abc"))), compose.shown_day(day))
    assert tuple(r) == ("resume_quux-ltd_qa-engineer_2026-09-24.pdf", "resume_company_role_2026-09-24.pdf", "unicode-co", "a, b and c", "24 Sep 2026")


def test_clipping_and_resume(spark):
    sections = F.array(F.struct(F.lit("Skills").alias("title"), F.array(F.lit("SQL"), F.lit("")).alias("lines")), F.struct(F.lit("None").alias("title"), F.array(F.lit("")).alias("lines")))
    r = one(spark, compose.clip_clause(F.lit("We built it, and then we rebuilt everything again"), 20), compose.clip_chars(F.lit("abcdef"), 4), compose.resume_text(F.lit("Name"), sections), compose.lower_first(F.lit("SQL work")), compose.joined([F.lit("a"), F.lit(None).cast("string"), F.lit("b")]))
    assert tuple(r) == ("We built it", "abc…", "Name\n\nSKILLS\nSQL", "SQL work", "a | b")


def plain_placed(categories, ks):
    import re

    words = lambda c: {re.sub("([^s])s$", r"\1", re.sub("ies$", "y", w)) for w in re.split("[^a-z0-9]+", c.lower()) if len(w) >= 3 and w not in compose.LABEL_STOP}
    out = [(c, list(items)) for c, items in categories]
    for _, _, display, grp in ks:
        if any(i.lower() == display.lower() for _, items in out for i in items):
            continue
        best, target = 0, None
        for c, items in out:
            if len(words(c) & words(grp)) > best:
                best, target = len(words(c) & words(grp)), items
        if target is None:
            target = []
            out.append((grp, target))
        target.append(display)
    return out


def test_placement_in_order(spark):
    ks = [(1, "x", "cPanel", "Web Hosting & Domains"), (2, "y", "Stew", "Cooking"), (3, "z", "Soup", "Cooking arts"), (4, "w", "html", "Web"), (5, "v", "Loose", "Databases"), (6, "u", "Postgres", "Database Design")]
    cats = [("Programming and Web", ["HTML"]), ("Web and Hosting", [])]
    p = spark.createDataFrame([(1, *k) for k in ks], "doc_id int, rank int, key string, display string, grp string")
    got = [(r["category"], r["items"]) for r in compose.placed(cats, p).orderBy("pos").collect()]
    assert got == plain_placed(cats, ks) and ("Cooking", ["Stew", "Soup"]) in got and ("Databases", ["Loose", "Postgres"]) in got
    assert [(r["category"], r["items"]) for r in compose.placed([], p.where("rank < 3")).orderBy("pos").collect()] == [("Web Hosting & Domains", ["cPanel"]), ("Cooking", ["Stew"])]
    from millrace.operators import keywords

    known = spark.createDataFrame([(1, 1, "excel", "Excel", "Office")], "doc_id int, rank int, key string, display string, grp string")
    assert [r["items"] for r in compose.placed([("Tools", ["MS Excel"])], known, keywords.lexicon_table(spark)).collect()] == [["MS Excel"]]
