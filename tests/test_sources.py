"""Connectors on landed payloads."""

import json

from pyspark.sql import functions as F

from millrace.sources import landed, sinks


def day():
    return F.lit("2026-10-10").cast("date")


def test_local_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"title": "QA Engineer", "company": "Acme", "salary": "Tk 20k", "deadline": "30 Oct 2026"}, {"title": "", "company": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"title": "Cook", "company": "B", "salaryMin": 5000}]))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text(json.dumps({"title": "One", "company": "D"}))
    got = {r["title"]: r for r in landed.local_json(spark, str(tmp_path), day()).collect()}
    assert set(got) == {"QA Engineer", "Cook", "One"}
    assert got["QA Engineer"]["salaryMin"] == 20000 and str(got["QA Engineer"]["deadline"]) == "2026-10-30" and got["Cook"]["salaryMin"] == 5000


def test_json_ld_nested(spark):
    page = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@type":["JobPosting"],"title":"A","hiringOrganization":"X","url":"https://e.example/a"}},{"item":{"@type":"JobPosting","title":"B","hiringOrganization":{"name":"Y"}}}]}</script><script type="application/ld+json">{bad</script>'
    p = spark.createDataFrame([("https://e.example", page), ("https://f.example", None)], "url string, body string")
    assert landed.ld_blocks(p).count() == 2
    got = landed.jsonld(p, day()).collect()
    assert [(r["title"], r["company"], r["url"]) for r in got] == [("A", "X", "https://e.example/a")]


def test_wordpress(spark):
    items = [{"id": 1, "date": "2026-10-01T00:00:00", "link": "https://b.example/x-at-some-firm/", "title": {"rendered": "QA &amp; Test | Lead | Acme"}, "content": {"rendered": "<p>Salary: Tk 20,000</p>2019-2023"}, "metas": {"_job_location": '{"7":"Dhaka"}', "_job_experience": "none"}}]
    r = landed.wordpress(spark.createDataFrame([("u", json.dumps(items))], "url string, body string"), day()).first()
    assert (r["title"], r["company"], r["location"], r["salaryMin"], r["experienceText"]) == ("QA & Test | Lead", "Acme", "Dhaka", 20000, "")


def test_career_links(spark):
    html = '<a href="/jobs/qa-engineer">QA Engineer</a><a href="/about">About our engineer team</a><a href="/jobs/x">Jobs</a><a href="/careers/data-analyst"><b>Data Analyst</b></a>'
    a = landed.job_links(landed.anchors(spark.createDataFrame([("https://c.example", html)], "url string, html string")))
    assert [r["text"] for r in a.orderBy("n").collect()] == ["QA Engineer", "Data Analyst"]


def test_cards_probe_and_mail(spark):
    html = '<div class="card"><a href="/job?id=1">One</a></div><div class="card"><a href="/job?id=2">Two</a><a href="/job?id=2">Again</a></div><a href="/other">x</a>'
    c = landed.cards(spark.createDataFrame([("u", html)], "url string, body string"), "id=")
    assert [(r["href"], r["css"]) for r in c.collect()] == [("/job?id=1", "card"), ("/job?id=2", "card")]
    assert landed.probe(c).first()["n"] == 2
    mail = b"Subject: alert\nDate: Tue, 06 Oct 2026 08:00:00 +0000\nContent-Type: text/html\n\n<p><a href='https://b.example/job/9?x=1'>QA Engineer</a></p><p>Acme</p><p>Banani, Dhaka</p>"
    m = landed.mail_alerts(spark.createDataFrame([("m", mail)], "path string, content binary"), day(), "/job/").first()
    assert (m["title"], m["company"], m["location"], m["url"]) == ("QA Engineer", "Acme", "Banani, Dhaka", "https://b.example/job/9")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, "c\nd")], "i int, t string")
    sinks.write_versioned(df, str(tmp_path / "t"), "1")
    sinks.write_versioned(df.where("i = 1"), str(tmp_path / "t"), "2")
    assert sinks.read_current(spark, str(tmp_path / "t")).count() == 1
    d = sinks.digest(df, [F.col("i")], 1, ("i", "t")).first()
    assert d["table"] == "| 1 | a/b |" and d["more"] == 1


def test_queries_keep_first_spelling(spark):
    assert landed.build_queries(spark, ["QA  Engineer", "qa engineer", "Dev"], []) == ["QA Engineer", "Dev"]


def test_listing_stops_at_a_short_page(spark, tmp_path):
    from millrace.sources import datasource

    for name, n in (("1", 2), ("2", 1), ("3", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": i, "link": f"https://b.example/{name}{i}", "title": {"rendered": f"T{name}{i} | Acme"}} for i in range(n)]))
    datasource.register(spark)
    pages = spark.read.format("landed_listing").option("path", str(tmp_path)).option("per_page", 2).load()
    assert sorted(r["title"] for r in landed.wordpress(pages, day()).collect()) == ["T10", "T11", "T20"]
