"""Requirements and application packs on small posts."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import compose, keywords, mining, pack, requirements

PROFILE = {
    "personal": {"fullName": "Ada Nor", "phone": "123", "email": "ada@x.example"},
    "education": [{"degree": "Bachelor of Science in Computer Science", "date": "2022 - now", "expectedGraduation": "May 2027"}],
    "experience": [{"role": "Test Engineer", "company": "Brindle Co.", "bullets": ["Designed test cases for SQL reports, and kept them current by hand every single week of the year", "Cooked lunch", ""]}],
    "projects": [{"name": "Loom", "bullets": ["Wrote Python and SQL for a loader", "Python scripts"]}],
    "preferences": {"experienceYears": 1, "locations": ["Banani", "Gulshan"], "expectedSalaryMin": 30000},
}
POST = """Tester wanted
Location: Banani, Dhaka
Salary: Tk 25,000 to 28,000
Experience: At least 3 years
Responsibilities:
Write SQL queries and Python checks for every release
Write reports
Requirements:
Python, SQL and Docker
5 years of Docker
Bachelor's degree
Communication
Send your CV and cover letter to jobs@quux.example with two references
"""


@pytest.fixture(scope="module")
def built(spark):
    lex = keywords.lexicon_table(spark)
    docs = spark.createDataFrame([(1, "Tester", "Quux", POST, None, datetime.date(2026, 10, 12)), (2, None, "Unknown company", None, "https://q.example/2", None)], "doc_id long, title string, company string, text string, url string, deadline date")
    k = keywords.evidence(mining.extract_all(docs, lex), lex, "Python, SQL, BSc", "test cases")
    k = pack.chosen(k, spark.createDataFrame([(1, ["docker", "bachelor's degree"])], "doc_id long, added array<string>")).cache()
    out = pack.build(docs, k, lex, PROFILE, F.lit("2026-10-10").cast("date"), "Python and so on")
    return {r["doc_id"]: r for r in out.collect()}, k, docs, lex


def test_comparisons(built):
    one, two = built[0][1], built[0][2]
    assert (one["place"]["text"], one["place_fit"]["state"]) == ("Banani, Dhaka", "match")
    assert (one["pay"]["lo"], one["pay"]["hi"], one["pay_fit"]["state"]) == (25000, 28000, "gap")
    assert (one["asks"], one["years"]["state"]) == ("At least 3 years", "gap") and one["degrees"]["state"] == "match"
    assert one["duties"] == ["Write SQL queries and Python checks for every release", "Write reports"]
    assert one["groups"]["required"]["total"] >= 4 and one["groups"]["required"]["matched"] == 2
    assert two["place"] is None and two["place_fit"] is None and two["pay_fit"] is None and two["years"] is None and two["degrees"] is None


def test_structured_facts_come_first(spark):
    d = spark.createDataFrame([(1, "Location: Sylhet\nSalary: 50,000", "Uttara", 4.5, 20000, None, "Remote work"), (2, "About 2 years of testing", "", None, None, None, None), (3, "Freshers welcome", None, 30.0, None, 9000, None), (4, "aged 20 to 25 years", None, None, None, None, None)], "doc_id long, text string, area string, distanceKm double, salaryMin int, salaryMax int, employmentType string")
    got = {r["doc_id"]: r for r in requirements.facts(d.withColumn("title", F.lit(""))).collect()}
    assert got[1]["place"] == ("Uttara", 4.5, True) and got[1]["pay"] == ("", 20000, None)
    assert got[2]["asks"] == "2 years" and got[3]["asks"] == "Freshers welcome" and got[2]["place"] is None and got[3]["pay"]["hi"] == 9000
    p = lambda text, km, remote: F.struct(F.lit(text).alias("text"), F.lit(km).cast("double").alias("km"), F.lit(remote).alias("remote"))
    one = spark.range(1).select(*[requirements.compare_place(x, y)["state"] for x, y in ((p("x", None, True), []), (p("x", 9.0, False), []), (p("x", 11.0, False), ["x"]), (p("Old Banani", None, False), ["banani"]), (p("Bana", None, False), ["Banani"]), (p("Sylhet", None, False), ["Banani"]), (p("Sylhet", None, False), []))]).first()
    assert tuple(one) == ("match", "match", "gap", "match", "match", "unknown", "unknown")
    years = spark.createDataFrame([("3+ years",), ("1 year",), ("freshers",), ("some",), (None,), ("age 22-30 years",)], "t string").select(requirements.compare_years(F.col("t"), 1.0)["state"])
    assert [r[0] for r in years.collect()] == ["gap", "match", "match", "unknown", None, "unknown"]


def test_degrees(spark):
    k = [(1, "bachelor's degree", "skills"), (2, "bachelor's degree", "none"), (3, "bachelor's degree", "skills"), (3, "bba", "none"), (4, "master's degree", "none"), (4, "bba", "skills"), (5, "bba", "skills"), (6, "bba", "none"), (7, "bachelor's degree", "skills"), (7, "bba", "skills")]
    df = spark.createDataFrame([(d, key, key.upper(), "degree", e, i) for i, (d, key, e) in enumerate(k)], "doc_id long, key string, display string, kind string, evidence string, rank int")
    got = {r["doc_id"]: r["degrees"]["state"] for r in requirements.compare_degrees(df).collect()}
    assert got == {1: "match", 2: "gap", 3: "partial", 4: "partial", 5: "match", 6: "gap", 7: "match"}
    old = {r["doc_id"]: r["state"] for r in keywords.compare_education(df).collect()}
    assert old == got


def test_needs_bullets_and_texts(built):
    rows, k, docs, lex = built
    one, two = rows[1], rows[2]
    assert set(one["needs"]) <= {"Python", "SQL", "Docker"} and len(one["needs"]) == 3 and len(one["overlap"]) == 2 and set(one["overlap"]) <= set(one["needs"])
    assert one["n_matched"] == 2 and [b["ord"] for b in one["picked"]] == [0, 2] or [b["ord"] for b in one["picked"]] == [2, 0]
    assert one["duty"] == "Write SQL queries and Python checks for every release" and one["duty_hits"] == 2
    letter = one["letter"]
    assert letter["words"] <= 180 and letter["words"] == len(letter["body"].split()) and "Tester position at Quux" in letter["body"] and "Computer Science student (degree expected May 2027)" in letter["body"]
    assert letter["text"].startswith("Dear Quux Hiring Team,") and letter["text"].endswith("Sincerely,\nAda Nor\n123 | ada@x.example")
    assert two["letter"]["text"].startswith("Dear Hiring Team,") and "[EDIT THIS: company]" in two["letter"]["body"] and "[EDIT THIS: role]" in two["letter"]["body"]
    assert two["n_matched"] == 0 and [b["ord"] for b in two["picked"]] == [0, 1] and "Some examples are general ones." in two["letter"]["notes"]
    assert one["mail"]["to"] == "jobs@quux.example" and one["mail"]["subject"] == "Application for Tester - Ada Nor" and "cover letter are attached" in one["mail"]["body"] and one["mail"]["words"] == len(one["mail"]["body"].split())
    assert two["mail"]["to"].startswith("[EDIT THIS") and "My resume is attached" in two["mail"]["body"]
    assert len(one["note"]) <= 300 and "Tester role at Quux" in one["note"] and "Test Engineer" in one["note"]


def test_documents_report_and_checklist(built):
    one, two = built[0][1], built[0][2]
    assert [(d["key"], d["from_post"]) for d in one["documents"]] == [("cv", True), ("cover", True), ("refs", True)] and [(d["key"], d["from_post"]) for d in two["documents"]] == [("cv", False)]
    assert one["added"] == ["Docker"] and any(g.startswith("Docker: 5 years asked") for g in one["gaps"]) and any(g.startswith("Salary: ") for g in one["gaps"]) and any(g.startswith("Communication") for g in one["gaps"])
    assert 0 < one["match_before"] < one["match_after"] <= 100 and two["gaps"] == [] and two["match_after"] == 0
    tasks = {t["key"]: (t["state"], t["note"]) for t in one["checklist"]}
    assert [t["key"] for t in one["checklist"]] == ["resume", "cover", "email", "recruiter", "url", "deadline", "docs", "placeholders"]
    assert tasks["cover"][0] == "todo" and tasks["url"] == ("info", "by mail to jobs@quux.example") and tasks["deadline"] == ("info", "2 days left") and tasks["docs"] == ("todo", "Cover letter, References")
    other = {t["key"]: (t["state"], t["note"]) for t in two["checklist"]}
    assert other["cover"][0] == "info" and other["url"] == ("info", "https://q.example/2") and other["deadline"][1] == "not stated" and other["docs"][0] == "info"
    n = sum(len(re.findall(r"\[EDIT THIS", t)) for t in (one["letter"]["text"], one["mail"]["text"], one["note"]))
    assert tasks["placeholders"] == ("todo", f"{n} placeholders left") and one["ask"]["state"] == "below" and one["ask"]["amount"] == 30000


def test_small_texts(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    lab = lambda a, b, c: pack.education_label(*[F.lit(x).cast("string") for x in (a, b, c)])
    assert one(lab("BSc in Physics", "Expected May 2027", None), lab("BSc in Physics", "2020", None), lab("MBA", None, "2028"), lab(None, None, None)) == ("Physics student (degree expected May 2027)", "Physics graduate", "MBA student (degree expected 2028)", "")
    text = F.lit("Dear A Team,\n\nfour words of body\n\nKind regards,\nAda Nor\n123")
    assert one(pack.body_words(text), pack.body_words(F.lit("no greeting here")), pack.body_words(F.lit(None).cast("string"))) == (4, 3, 0)
    clip = [pack.clip_words(F.lit(t), 6) for t in ("short one.", "one two three four, five six seven", "one two three four five and seven eight", "a b c d e f g")]
    assert one(*clip) == ("short one", "one two three four", "one two three four five", "a b c d e f")
    saved = spark.createDataFrame([(json.dumps(x),) for x in ({"added": ["a", "a", 3], "skipped": ["a", "b"]}, {"claimed": ["c"], "off": ["d"], "enabled": False}, {"added": "x"}, [])] + [(None,)], "value string")
    assert [(r["enabled"], r["added"], r["skipped"]) for r in pack.normalized_decisions(saved).collect()] == [(True, ["a"], ["b"]), (False, ["c"], ["d"]), (True, [], []), (True, [], []), (True, [], [])]
    jobs = [{"role": "Cook", "bullets": ["stew"]}, {"role": "Tester", "tags": ["SQL"]}, {"role": "SQL tester", "bullets": ["Python"]}]
    assert [j["role"] for j in pack.rank_experience(jobs, ["SQL", "Python"])] == ["SQL tester", "Tester", "Cook"]
    b = lambda kind, role, firm: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(firm).alias("firm"))
    e, p = "experience", "project"
    ctx = [F.array(b(e, "T", "Co."), b(e, "T", "Co.")), F.array(b(e, "T", "")), F.array(b(e, "", "Co")), F.array(b(p, "", "Loom")), F.array(b(p, "", "Loom"), b(e, "T", "Co"))]
    assert one(*map(pack.context_of, ctx)) == ("my T role at Co", "my T role", "my work at Co", "my Loom project", "my resume")
    assert len(compose.DOCUMENTS) == 10
