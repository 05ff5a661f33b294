"""Records, notices and lists against stated values and plain versions."""

import datetime
import json

from pyspark.sql import functions as F

from millrace.operators import records, state
from millrace.sources import sinks

PROFILE = {
    "personal": {"fullName": "Ada Nor"}, "skills": [{"category": "Data", "items": ["SQL", "", None]}, {"category": None, "items": None}],
    "experience": [{"role": "Tester", "company": "Quux", "location": "", "duration": "2024", "priorTitle": None, "priorDuration": None, "bullets": ["did it", ""]}],
    "projects": [{"name": "P", "subtitle": "", "bullets": None}], "education": [{"degree": "BSc", "date": None, "institution": "U", "score": "3.9", "expectedGraduation": "May 2027"}],
    "references": [{"name": "", "title": "x", "email": "", "phone": ""}, {"name": "R", "title": "Dr", "email": "r@x.example", "phone": None}],
}
KIND = (
    "struct<personal struct<fullName string>, skills array<struct<category string, items array<string>>>, experience array<struct<role string, company string, location string, duration string, priorTitle string, priorDuration string, bullets array<string>>>, "
    "projects array<struct<name string, subtitle string, bullets array<string>>>, education array<struct<degree string, date string, institution string, score string, expectedGraduation string>>, references array<struct<name string, title string, email string, phone string>>>"
)


def document(spark, profile=PROFILE):
    p = spark.createDataFrame([(json.dumps(profile),)], "j string").select(F.from_json("j", KIND).alias("p"))
    t = F.lit("t")
    return p.select(records.resume_document(F.col("p"), F.lit(None).cast("string"), t, t, t, t).alias("d"))


def test_resume_document(spark):
    d = document(spark).first()["d"].asDict(True)
    assert d["name"] == "Ada Nor" and d["headline"] == "" and d["skillRows"] == [{"category": "Data", "items": ["SQL"]}, {"category": "", "items": []}]
    assert d["experience"] == [{"title": "Tester, Quux", "meta": "2024", "priorTitle": "", "priorDuration": "", "bullets": ["did it"]}]
    assert d["projects"] == [{"title": "P", "name": "P", "subtitle": "", "bullets": []}]
    assert d["education"] == [{"degree": "BSc", "date": "", "detail": "U\n3.9 | Expected graduation: May 2027"}]
    assert d["references"] == [{"name": "R", "title": "Dr", "contact": "r@x.example"}]
    assert document(spark).select(records.is_resume(F.col("d"))).first()[0] is True
    empty = document(spark, {}).first()["d"].asDict(True)
    assert empty["name"] == "" and empty["experience"] == empty["education"] == []


def test_versions_are_made_read_back_and_checked(spark):
    jobs = spark.createDataFrame([("7", " Quux ", "Tester", 20000, None), ("8", None, None, None, "x")], "id string, company string, title string, salaryMin int, url string")
    now = F.lit(datetime.datetime(2026, 9, 22, 8, 0))
    doc = document(spark).first()["d"].asDict(True)
    doc_column = F.from_json(F.lit(json.dumps(doc)), records.RESUME)
    v = records.make_version(jobs, now, keywordsAdded=F.array(F.lit("SQL"), F.lit(None)), doc=doc_column, strategy=F.lit("direct"))
    rows = {r["jobId"]: r for r in v.collect()}
    assert rows["7"]["company"] == "Quux" and rows["7"]["salary"]["postedMin"] == 20000 and rows["7"]["keywordsAdded"] == ["SQL", ""] and rows["7"]["appliedOn"] == "2026-09-22"
    assert rows["8"]["title"] == "" and rows["8"]["salary"]["postedMin"] is None and rows["8"]["url"] == "x" and rows["8"]["strategy"] == "direct"
    assert {r["id"] for r in v.collect()} == {r["id"] for r in rows.values()} and len({r["id"] for r in rows.values()}) == 2
    good = json.loads(v.where("jobId = '7'").select(F.to_json(F.struct("*"))).first()[0])
    good.pop("url", None)
    bad = [{**good, "id": ""}, {**good, "appliedOn": "yesterday"}, {**good, "doc": {"name": "x"}}, {**good, "pack": None}, {**good, "keywordsAdded": ["a", None]}, "no json", {**good, "doc": {**good["doc"], "skillRows": [{"items": []}]}}]
    stored = [(i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate([*bad, {**good, "title": "first"}, {**good, "title": "second"}])]
    got = records.normalize_versions(spark.createDataFrame(stored, "seq int, value string")).collect()
    assert [(r["title"], r["url"], r["salary"]["note"], r["report"]["gaps"]) for r in got] == [("first", "", "", [])]
    assert records.normalize_versions(spark.createDataFrame([], "seq int, value string")).count() == 0


def test_lines_sizes_and_private_texts(spark):
    d = spark.createDataFrame([("Quux", "Tester", "2026-09-22"), ("", None, None)], "c string, t string, d string")
    assert [r[0] for r in d.select(records.version_line(F.col("c"), F.col("t"), F.col("d"))).collect()] == ["Quux - Tester - applied 22 Sep 2026", "Unknown company - Unknown role - applied "]
    assert d.select(records.storage_size(F.struct("c", "t"))).collect()[0][0] == len('{"c":"Quux","t":"Tester"}')
    whole = {"headline": "h", "summary": "", "experienceText": "e", "projectsText": "p"}
    entries = [{"resumeOverrides": whole, "applicationPack": {"email": "m", "coverLetter": 5}}, {"resumeOverrides": {**whole, "summary": 3}}, {"applicationPack": {"recruiter": "r"}}, {"applicationPack": []}, [], {}]
    stored = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(entries)] + [(90, "{bad"), (91, None)], "id int, value string")
    got = {r["id"]: r.asDict(True) for r in records.normalize_private(stored).collect()}
    assert set(got) == {0, 2} and got[0]["resumeOverrides"] == whole and got[0]["applicationPack"] == {"coverLetter": None, "email": "m", "recruiter": None}
    assert got[2] == {"id": 2, "resumeOverrides": None, "applicationPack": {"coverLetter": None, "email": None, "recruiter": "r"}}
    labels = spark.createDataFrame([("First name",), ("Your e-mail",), ("Name",), ("City and name",), ("CGPA / Result",), ("Shoe size",), (None,)], "l string")
    assert [r[0] for r in labels.select(records.field_of(F.col("l"))).collect()] == ["firstName", "email", "fullName", "location", "cgpa", None, None]


FEED = (
    "title string, company string, area string, location string, category string, source string, url string, salaryText string, salaryMin int, salaryMax int, distanceKm double, "
    "matchScore int, priority string, status string, deadline date, postedAt date, gateNotes array<string>, fingerprint string"
)


def feed(spark, n=30):
    day = datetime.date(2026, 9, 1)
    rows = [(f"Role {i} <b>|", f"Firm {i % 3}", "Area" if i % 2 else "", "Town", "IT", "Board", f"https://b.example/{i}", "" if i % 4 else "Tk 9", i if i % 5 else None, i * 2 if i % 3 else None, 1.5 if i % 2 else None, i, "ABC"[i % 3], "Awaiting Review" if i % 2 else "Saved", day + datetime.timedelta(i) if i % 7 else None, None if i % 6 else day, [f"note {i}", "two", "three"] if i % 2 else [], f"f{i:02}") for i in range(n)]
    return spark.createDataFrame(rows, FEED), rows


def test_review_lists_and_orders(spark):
    df, rows = feed(spark)
    names = [c.split()[0] for c in FEED.split(", ")]
    plain = [dict(zip(names, r, strict=True)) for r in rows]
    ids = lambda d: [r["fingerprint"] for r in d.collect()]
    keep = {"all": lambda r: True, "pending": lambda r: r["status"] == "Awaiting Review", "A": lambda r: r["priority"] == "A", "flagged": lambda r: bool(r["gateNotes"])}
    for show, ok in keep.items():
        for q in ("", " FIRM 1 ", "area town"):
            want = [r["fingerprint"] for r in plain if ok(r) and q.strip().lower() in " ".join([r["title"], r["company"], r["area"], r["location"], r["category"]]).lower()]
            assert sorted(ids(state.visible(df, show, q))) == want
    last = lambda v: (v is None, v)
    want = {
        "match": lambda r: -r["matchScore"], "newest": lambda r: (r["postedAt"] is None, r["fingerprint"]), "deadline": lambda r: last(r["deadline"]),
        "priority": lambda r: (r["priority"], -r["matchScore"]), "salary": lambda r: (lambda v: (v is None, -(v or 0)))(r["salaryMax"] if r["salaryMax"] is not None else r["salaryMin"]),
    }
    for by, key in want.items():
        order = [r["fingerprint"] for r in sorted(plain, key=lambda r: (key(r), r["fingerprint"]) if by != "deadline" else (r["deadline"] is None, r["deadline"] or datetime.date.min, r["fingerprint"]))]
        assert ids(state.dashboard_order(df, by)) == order, by
    facts = {r["fingerprint"]: r["f"] for r in df.select("fingerprint", state.fact_line().alias("f")).collect()}
    assert facts["f01"] == ["IT", "Area, 1.5 km away", "pay not stated", "closes 2026-09-02", "found on Board"] and facts["f00"] == ["IT", "Town", "Tk 9", "found on Board"]


def test_notices(spark):
    df, rows = feed(spark)
    best = [F.desc("matchScore")]
    one = sinks.issue(df, best, "ada", "https://r.example").first()
    assert one["title"].startswith("30 new matches: Role 29") and one["body"].startswith("@ada 30 new matches") and "and 5 more" in one["body"] and one["body"].endswith("https://r.example")
    assert one["body"].count("- **Role") == 8 and "| A | Role 27 <b>/ | Firm 0 | 27 |" in one["body"]
    long = sinks.issue(df.withColumn("title", F.repeat(F.lit("x"), 5000)), best).first()
    assert len(long["title"]) == 250 and len(long["body"]) == 60_000
    page = sinks.html_digest(df, best).first()["html"]
    assert page.count("<tr>") == 25 and "Role 29 &lt;b&gt;|" in page and "note 29<br>two</td>" in page and "three" not in page and "Area &middot; 1.5 km" in page
    sent = json.loads(sinks.webhook_payload(df, best, "https://r.example").first()["value"])
    assert sent["content"] == sent["text"] and sent["text"].count("\n`") == 10 and len(sent["jobs"]) == 30 and sent["text"].endswith("Review: https://r.example")
    for f in (sinks.issue, sinks.html_digest, sinks.webhook_payload):
        assert f(df.where("false"), best).count() == 0
    a = spark.createDataFrame([("rss", 4, ["timed out"]), ("web", 5, [])], "source string, streak int, errors array<string>")
    told = {r["source"]: r for r in sinks.source_problem(a).collect()}
    assert told["rss"]["title"] == "Source problem: rss, 4 silent runs" and "- timed out" in told["rss"]["body"] and "served no postings" in told["web"]["body"]
    report = spark.createDataFrame([("rss", 3, 9)], "discoveredBy string, found int, raw int")
    counts = spark.createDataFrame([(3, 1)], "total int, new int")
    d = json.loads(sinks.run_digest(counts, report, ["qa"], {"min": 1}, [f"u{i}" for i in range(30)], F.lit("now")).first()["value"])
    assert d == {"queries": ["qa"], "sources": {"rss": {"found": 3, "raw": 9}}, "counts": {"total": 3, "new": 1}, "filters": {"min": "1"}, "blockedUrls": [f"u{i}" for i in range(20)], "ranAt": "now"}
    whole = json.loads(sinks.feed_document(df.limit(2), {"n": F.lit(2)}, F.lit("now")).first()["value"])
    assert whole["schema"] == 1 and whole["meta"] == {"n": 2} and len(whole["jobs"]) == 2


def test_a_pointer_is_never_overwritten(spark, tmp_path):
    root = str(tmp_path / "t")
    assert sinks.read_current(spark, root) is None
    df = spark.range(3)
    sinks.write_versioned(df, root, "a")
    before = sinks.read_current(spark, root)
    sinks.write_versioned(df.where("id = 1"), root, "b")
    assert before.count() == 3 and sinks.read_current(spark, root).count() == 1
    (tmp_path / "t" / "_current" / "000000000003").mkdir()  # a pointer whose writing has not ended
    assert sinks.read_current(spark, root).count() == 1
