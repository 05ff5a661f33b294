"""Column functions against stated values."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import parse, text
from millrace.operators import dedupe, keywords


def each(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_company_forms(spark):
    got = each(spark, ["Brindlework IT Ltd.", "Brindlework I.T. Limited", "The Acme (BD) Group", "Unknown company", "Ltd", None], text.normalize_company)
    assert got == ["brindlework", "brindlework", "acme", "unknown", "ltd", ""]


def test_title_forms(spark):
    got = each(spark, ["Urgent Hiring: SQA Engineer (Remote)", "QA Engineer for Fintech Product", None, "Engr / Dev"], text.normalize_title)
    assert got == ["software quality assurance engineer", "quality assurance engineer", "", "engineer developer"]
    assert each(spark, ["Senior QA Lead"], lambda c: text.normalize_title(c, True)) == ["quality assurance"]


def test_html_and_space(spark):
    got = each(spark, ["<p>a  b</p><script>x<y</script><br>c&amp;d &nbsp; e", None, ""], text.strip_html)
    assert got == ["a b\nc&d e", "", ""]


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("Tk. 20,000 - 25,000 (Monthly)", (20000, 25000, "Tk 20,000 - 25,000")), ("Salary: Tk 18k", (18000, None, "Tk 18,000")), ("Tk. 1.2 lakh", (120000, None, "Tk 120,000")),
        ("Negotiable", (None, None, "Negotiable")), ("Tk 30,000 to Tk 20,000", (20000, 30000, "Tk 20,000 - 30,000")), ("", (None, None, "")), ("2.5.1 taka", (None, None, "")),
    ],
)
def test_salary(spark, t, want):
    assert tuple(each(spark, [t], parse.parse_salary)[0]) == want


def test_dates(spark):
    day = F.lit("2026-10-10").cast("date")
    got = each(spark, ["25 Sep 2026", "junk", "2 days ago", "today", None, "Tue, 06 Oct 2026 08:00:00 +0000"], lambda c: parse.parse_date(c, day))
    d = datetime.date
    assert got == [d(2026, 9, 25), None, d(2026, 10, 8), d(2026, 10, 10), None, d(2026, 10, 6)]


def test_places(spark):
    got = each(spark, ["Banani, Dhaka", "Gazipur", "Work from home", "Dhaka", None], lambda c: parse.resolve_area(c, F.lit(None).cast("string")))
    assert [r["area"] for r in got] == ["Banani", "Gazipur", "Remote", "Dhaka (area not stated)", ""]
    assert got[0]["km"] < 10 < 20 < got[1]["km"]
    assert got[2]["km"] == 0 and got[3]["km"] is None and got[4]["km"] is None
    assert each(spark, ["Romania", "Dubai, UAE", "Dhaka, UK desk", None], parse.foreign_country) == ["Romania", "Dubai", None, None]


def test_monthly_pay(spark):
    df = spark.createDataFrame([(30000.0, "MONTH", "BDT"), (600000.0, "YEAR", "BDT"), (300.0, "HOUR", "BDT"), (500.0, "MONTH", "USD"), (0.0, "MONTH", "BDT")], "v double, u string, c string")
    assert [r[0] for r in df.select(parse.monthly_pay(F.col("v"), F.col("u"), F.col("c"))).collect()] == [30000, 50000, None, None, None]


def test_urls(spark):
    got = each(spark, ["HTTPS://A.example/Jobs/?utm_source=x&id=7&b=2#top", "https://a.example/jobs?b=2&id=7&ref=1&z=", "", None], text.canonical_url)
    assert got[0] == got[1] == "https://a.example/jobs?b=2&id=7" and got[2:] == ["", ""]


@pytest.mark.parametrize(("title", "exp", "want"), [("Senior Engineer", "", 10), ("Junior Engineer", "5 years", 100), ("Engineer", "Freshers", 100), ("Engineer", "", 65), ("Engineer", "2 years", 100), ("Engineer", "3 years", 80), ("Engineer", "12–15 years", 10), ("Engineer", "5+ yrs", 30)])
def test_level(spark, title, exp, want):
    df = spark.createDataFrame([(title, exp)], "t string, e string")
    assert df.select(parse.level_fit(F.col("t"), F.col("e"), F.lit(""), 2)).first()[0] == want


def test_salary_suggestion(spark):
    df = spark.createDataFrame([(25000, 50000, 30000), (40000, 50000, 30000), (20000, 25000, 30000), (None, None, 30000)], "a int, b int, e int")
    got = [tuple(r[0]) for r in df.select(keywords.suggest_salary(F.col("a"), F.col("b"), F.col("e"))).collect()]
    assert got == [("inside", 30000), ("inside", 40000), ("below", 30000), ("anchor", 30000)]


def test_words_of_a_slug_as_the_slug_has_them(spark):
    texts = ["Crème-brûlée  C++/C# v2.0", "été\u0301 I\u0307stanbul \u0130zmir Œuvre ße", "a/b .. 日本 x\u00a0yz naïve\tﬁn", "", " - ", None, "Straße ĲSSEL 1ª"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.slug(F.col("t")).alias("s"), F.lower(text.text_or_empty(F.col("t"))).alias("low"))
    for r in df.collect():
        assert [w.decode() for w in text.slug_words(r["low"])] == [w for w in r["s"].split(" ") if len(w) > 2]
    plan = df.select(dedupe.simhash(F.col("low")))._jdf.queryExecution().executedPlan().toString()
    assert "translate" not in plan  # texts are not walked letter by letter
