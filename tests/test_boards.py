"""Boards, fan-in, and texts beyond the built-in path."""

import html
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import parse, text
from millrace.sources import boards, fanin, landed


def day():
    return F.lit("2026-10-10").cast("date")


SELECTORS = {"card": "div.card, tr.row", "title": "h2 a, a.name", "company": ".firm", "location": "span#place", "deadline": ".until", "link_contains": "jobdetail"}
PAGE = """<html><body><div class="card hot"><h2><a href="/jobdetail/1">QA Engineer</a></h2><span class="firm">Quux <b>Ltd</b></span><span id="place">Banani</span>
<p class="until">30 Oct 2026</p><p>Salary: Tk 30,000</p><br></div><table><tr class="row"><td><a class="name" href="https://o.example/2">Data Analyst</a></td></tr></table>
<div class="card"><h2><a href="/jobdetail/1">Again</a></h2></div><div class="card"><a href="/x">Hi</a></div><div class="other"><a href="/y">Nothing here</a></div></body></html>"""


def test_selectors():
    root = boards.tree("<div class='a b'><p id=x>one<i class=c>two</i></p></div><p class='c'>three</p>")
    texts = lambda s: [n.text() for n in boards.select(root, s)]
    assert texts(".a .c") == ["two"] and texts("div.a.b p#x, p.c") == ["one two", "three"] and texts("p p") == [] and texts("") == []
    assert boards.tree(None).text() == "" and boards.detail_text("<body><nav>n</nav><main><p>a</p><script>s</script>b</main></body>", ".no") == "a\nb"


def test_board_and_details(spark):
    p = spark.createDataFrame([("https://b.example/s?q=1", PAGE), ("https://c.example/", '<li><a href="/JobDetail?id=9">Plain Tester</a></li>'), ("https://d.example/", None)], "url string, body string")
    b = boards.board(p, day(), SELECTORS, "Own")
    got = {r["url"]: r for r in b.collect()}
    assert set(got) == {"https://b.example/jobdetail/1", "https://o.example/2", "https://c.example/JobDetail?id=9"}
    one = got["https://b.example/jobdetail/1"]
    assert (one["title"], one["company"], one["location"], str(one["deadline"]), one["salaryMin"], one["source"]) == ("QA Engineer", "Quux Ltd", "Banani", "2026-10-30", 30000, "Own")
    assert got["https://o.example/2"]["company"] == "Unknown company"
    long = "<body><header>h</header><div class='job'>" + "test cases and regression testing " * 40 + "<p>Tk 50,000 - 60,000</p></div></body>"
    details = spark.createDataFrame([("https://o.example/2", long), ("https://o.example/2", long), ("https://c.example/JobDetail?id=9", "<body>x</body>"), ("https://z.example", long)], "url string, body string")
    more = {r["url"]: r for r in boards.with_details(b, details, "div.job").collect()}
    assert len(more) == 3 and more["https://o.example/2"]["salaryMax"] == 60000 and "regression" in more["https://o.example/2"]["description"] and more["https://o.example/2"]["category"] == "Software Quality Assurance"
    assert more["https://b.example/jobdetail/1"]["description"] == one["description"] and more["https://c.example/JobDetail?id=9"]["salaryMin"] is None
    few = {r["url"]: r for r in boards.with_details(b, details, "div.job", most=1).collect()}
    assert few["https://o.example/2"]["salaryMin"] is None
    assert boards.search_urls("https://b.example/?q={query}&pg={page}", ["qa & test"], 2) == ["https://b.example/?q=qa+%26+test&pg=1", "https://b.example/?q=qa+%26+test&pg=2"]
    d = spark.createDataFrame([("https://b.example/a/b", " ../c "), ("https://b.example", "mailto:x"), ("https://b.example", None)], "b string, h string")
    assert [r[0] for r in d.select(boards.joined_url(F.col("b"), F.col("h"))).collect()] == ["https://b.example/c", "", ""]


LD = '<script type="application/ld+json">{}</script>'


def item(title, url, **more):
    return {"@type": "JobPosting", "title": title, "url": url, "hiringOrganization": {"name": "Quux"}, **more}


def test_json_ld_values(spark):
    pay = lambda **v: {"baseSalary": {"value": v}}
    items = [item("A", "https://e.example/a", employmentType=["INTERN", "FULL_TIME", "shift_work"], **pay(minValue=20000, maxValue=30000, unitText="MONTH")), item("B", "https://e.example/b", employmentType="INTERNSHIP", **pay(value=600000, maxValue=100, unitText="YEAR")), item("C", "https://e.example/c", baseSalary={"currency": "USD", "value": {"value": 9}})]
    p = spark.createDataFrame([("https://e.example", LD.replace("{}", json.dumps(items)))], "url string, body string")
    got = {r["title"]: r for r in landed.jsonld(p, day()).collect()}
    assert (got["A"]["employmentType"], got["A"]["salaryText"], got["A"]["salaryMax"]) == ("Internship, Full time, Shift Work", "Tk 20,000 - 30,000", 30000)
    assert (got["B"]["employmentType"], got["B"]["salaryMin"], got["B"]["salaryMax"], got["B"]["salaryText"]) == ("Internship", 50000, None, "Tk 50,000")
    assert got["C"]["salaryMin"] is None
    d = spark.createDataFrame([(100.0, "MONTH", None), (100.0, "MONTH", ""), (100.0, "", "bdt"), (100.0, "MONTH", "EUR")], "v double, u string, c string")
    assert [r[0] for r in d.select(parse.monthly_pay(F.col("v"), F.col("u"), F.col("c"))).collect()] == [100, 100, 100, None]


def test_sites(spark):
    sites = [{"url": "https://a.example/?q={query}", "label": "A", "max_queries": 1, "queries": ["data analyst", "left out"]}, {"url": "https://b.example/", "label": "B"}, {"label": "no url"}]
    assert fanin.pages_of_sites(sites, ["qa engineer"]) == [(0, "https://a.example/?q=data+analyst"), (1, "https://b.example/")]
    pages = [("https://a.example/?q=data+analyst", LD.replace("{}", json.dumps([item("Data Analyst", "https://x.example/1"), item("Cook", "https://x.example/2"), item("QA Engineer", "https://x.example/3")])))]
    p = spark.createDataFrame([*pages, ("https://b.example/", "")], "url string, body string")
    found, raw, errors = fanin.jsonld_sites(p, day(), sites, ["qa engineer"])
    assert sorted((r["title"], r["source"]) for r in found.collect()) == [("Data Analyst", "A"), ("QA Engineer", "A")] and raw == 3
    assert errors == ["B: empty or refused response for https://b.example/"]
    both = spark.createDataFrame([*pages, ("https://b.example/", pages[0][1])], "url string, body string")
    found, raw, errors = fanin.jsonld_sites(both, day(), sites, ["qa engineer"], "all")
    assert sorted((r["url"], r["source"]) for r in found.collect()) == [(f"https://x.example/{i}", "A") for i in (1, 2, 3)] and raw == 6 and not errors


def test_fan_in_is_isolated(spark):
    feed = spark.createDataFrame([("u", "<item><title>QA at Quux</title><link>https://r.example/1</link></item><item><title>Cook at Quux</title><link>https://r.example/2</link></item>")], "url string, body string")
    asked = {}

    def rss(own, queries):
        asked["rss"] = queries
        return landed.rss(feed, day(), queries=queries), landed.rss_raw(feed), []

    def late(own, queries):  # fails while it runs, not before
        return landed.rss(feed.withColumn("body", F.raise_error(F.lit("boom"))), day()), 7, ["slow"]

    def crash(own, queries):
        raise RuntimeError("no key")

    config = {"rss": {"queries": ["qa"]}, "late": True, "crash": {"enabled": True}, "off": False, "quiet": {}, "unknown": {"enabled": True}}
    jobs, report = fanin.collect(spark, config, {"rss": rss, "late": late, "crash": crash, "off": crash, "quiet": crash}, ["other"], {"rss": True})
    rows = {r["discoveredBy"]: r for r in report.collect()}
    assert [r["title"] for r in jobs.collect()] == ["QA"] and asked["rss"] == ["qa"] and set(rows) == {"rss", "late", "crash", "unknown"}
    assert (rows["rss"]["found"], rows["rss"]["raw"], rows["rss"]["errors"]) == (1, 2, [])
    assert rows["late"]["found"] == 0 and rows["late"]["errors"][0] == "slow" and len(rows["late"]["errors"]) == 2 and rows["crash"]["errors"] == ["RuntimeError: no key"] and rows["unknown"]["errors"] == ["unknown source"]


def test_local_problems(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs": [{"title": "x", "company": "y"}, {"title": "x"}]}')
    (tmp_path / "b.json").write_text("{bad")
    got = sorted((r["file"].rpartition("/")[2], r["error"]) for r in landed.local_problems(spark, str(tmp_path)).collect())
    assert got == [("a.json", "entry without title or company"), ("b.json", "does not parse")]


def test_mail_limits_and_noise(spark):
    mail = lambda d, n: f"Subject: s\nDate: Tue, {d} Oct 2026 08:00:00 +0000\nContent-Type: text/html\n\n<p><a href='https://b.example/job/{n}'>Role {n}</a></p><p>Easy apply</p><p>Quux</p><p><a href='https://b.example/job/v{n}'>View job</a></p>".encode()
    m = spark.createDataFrame([(f"m{n}", mail(d, n)) for n, d in enumerate(("01", "08", "09", "10"))], "path string, content binary")
    titles = lambda **how: sorted(r["title"] for r in landed.mail_alerts(m, day(), "/job/", **how).collect())
    assert titles() == ["Role 0", "Role 1", "Role 2", "Role 3"] and titles(lookback_days=2) == ["Role 1", "Role 2", "Role 3"] and titles(most_messages=2) == ["Role 2", "Role 3"]
    assert {r["company"] for r in landed.mail_alerts(m, day(), "/job/").collect()} == {"Quux"}


@pytest.mark.parametrize("full", [False, True])
def test_texts_beyond_ascii(spark, full):
    raw = ["<p>Caf&eacute; &#x41;&amp;B</p>ﬁne ①", "ПривЕт Ё", "Ünïcode", None, "a　b \xa0 c"]
    d = spark.createDataFrame([(r,) for r in raw], "t string")
    got = d.select(text.strip_html(F.col("t"), full), text.slug(F.col("t"), full)).collect()
    assert got[2][1] == "unicode" and got[3] == ("", "")
    if full:
        plain = unicodedata.normalize("NFKC", html.unescape("Caf&eacute; &#x41;&amp;B\nﬁne ①"))
        assert got[0][0] == plain and got[4][0] == "a b c"
        marked = spark.createDataFrame([("Ё ñ ẽ が",)], "t string").select(text.strip_all_accents(F.col("t"))).first()[0]
        assert marked == "".join(x for x in unicodedata.normalize("NFKD", "Ё ñ ẽ が") if not unicodedata.combining(x))
