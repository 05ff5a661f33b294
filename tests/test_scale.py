"""Grid, trigram lists, page layouts and SQL functions against plain forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace import sql
from millrace.functions import fixed, text
from millrace.operators import places, search, state
from millrace.sources import pages

# -- grid ----------------------------------------------------------------------------------


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return round(2 * fixed.EARTH_KM * math.asin(math.sqrt(h)), 1)


@pytest.mark.parametrize("radius", [0.5, 30, 700, 9000])
def test_within_km_equals_all_pairs(spark, radius):
    rng = random.Random(radius)
    spot = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(23.6, 23.9), rng.uniform(90.3, 90.5)), (rng.choice([90.0, -90.0, 89.99, -89.9]), rng.uniform(-180, 180)), (rng.uniform(-3, 3), rng.choice([179.99, -179.99, 180.0, -180.0]))])
    post, home = ([(i, *spot()) for i in range(n)] for n in (400, 60))
    schema = "{} long, lat double, lon double"
    p = spark.createDataFrame([*post, (9001, None, 1.0), (9002, 95.0, 1.0), (9003, 5.0, None)], schema.format("seq"))
    got = places.within_km(p, spark.createDataFrame([*home, (77, None, None)], schema.format("home")), radius).collect()
    want = {(h[0], q[0]) for h in home for q in post if km(h, q) <= radius}
    assert {(r["home"], r["seq"]) for r in got} == want and len(got) == len(want) and want


def test_only_neighbouring_cells_meet(spark):
    """A grid of a million pairs of which few are near: the join makes few rows."""
    p = spark.range(2000).selectExpr("id seq", "cast(id % 50 as double) lat", "cast(floor(id / 50) as double) lon")
    h = p.select(F.col("seq").alias("home"), "lat", "lon")
    near = places.within_km(p, h, 50)
    assert near.count() == 2000 and near.where("home <> seq").count() == 0


# -- search --------------------------------------------------------------------------------


def test_search_equals_contains_and_reads_candidates(spark, tmp_path):
    rng = random.Random(3)
    words = ["Quality", "engineer", "café", "data", "dat", "ata", "xyz", "Ünï"]
    rows = [(i * 37_000, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))])) for i in range(900)]
    feed = spark.createDataFrame([(*r, 1) for r in rows], "seq long, body string, id int").repartition(6)
    index = search.TextIndex(spark, str(tmp_path / "lists"), "seq", "body")
    index.build(feed)
    for term in ("data", "café d", "QUALITY eng", "xyz xyz", "nowhere", "at", "", "ünï", "data data data"):
        want = sorted(i for i, t in rows if term.lower() in (t or "").lower())
        assert sorted(r["seq"] for r in index.search(feed, term).collect()) == want, term
    assert index.candidates("xyz xyz").count() < 500 and index.candidates("nowhere").count() == 0
    empty = search.TextIndex(spark, str(tmp_path / "none"), "seq", "body")
    empty.build(feed.where("false"))
    assert empty.search(feed.where("false"), "data").count() == 0


def test_search_prunes_lists_by_trigram(spark, tmp_path):
    index = search.TextIndex(spark, str(tmp_path / "lists"), "seq", "body")
    index.build(spark.range(100).selectExpr("id seq", "concat('row ', id, ' of this') body"))
    plan = index.candidates("row")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "trigram" in plan.split("PushedFilters", 1)[1][:200]


# -- pages ---------------------------------------------------------------------------------


def test_pages_equal_offsets(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"f{i:05}", rng.choice([None, *range(40)]), rng.choice(["A", "B", "C"])) for i in range(3000)]
    feed = spark.createDataFrame(rows, "fingerprint string, matchScore int, priority string").repartition(5)
    path = str(tmp_path / "match")
    pages.write_pages(feed, state.dashboard_keys("match"), path, 250)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for number in (0, 3, 59, 60):
        got = pages.page(spark, path, number, 50)
        assert [r["fingerprint"] for r in got.collect()] == [r[0] for r in order[number * 50 : number * 50 + 50]]
        assert "(file#" in got._jdf.queryExecution().toString().rpartition("PartitionFilters")[2][:120]  # other files are not opened
    seen = order[1234]
    past = F.col("matchScore").isNull() | (F.col("matchScore") < seen[1]) | ((F.col("matchScore") == seen[1]) & (F.col("fingerprint") > seen[0]))
    after = pages.page_after(spark, path, past, 20)
    assert [r["fingerprint"] for r in after.collect()] == [r[0] for r in order[1235:1255]]
    pages.write_pages(feed.where("false"), state.dashboard_keys("match"), str(tmp_path / "none"), 250)


# -- SQL -----------------------------------------------------------------------------------


def test_sql_functions_equal_column_functions(spark):
    sql.register(spark)
    sql.register(spark)  # again does no harm
    t = spark.createDataFrame([("Jr. QA Engr & Développer  (C++)",), ("https://A.example/x y@b.co",), ("",), (None,)], "x string")
    t.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT mr_slug(x), mr_words(x), mr_expand(x), mr_first_email(x) FROM sql_texts").collect()
    x = F.col("x")
    want = t.select(text.slug(x), text.words(x), text.expand_abbreviations(x), text.first_email(x)).collect()
    assert list(map(tuple, got)) == list(map(tuple, want))
    assert spark.sql("SELECT mr_km(23.7, 90.4, 23.8, 90.4)").first()[0] == km((0, 23.7, 90.4), (0, 23.8, 90.4))


def test_table_functions(spark):
    sql.register(spark)
    html = "<a href='/1'>One <b>more</b></a> x <a name=n>no</a><a href=\"/2\">T&amp;wo<a href=/3>three</a> <script type='application/ld+json'>{\"@graph\":[{\"@type\":\"JobPosting\",\"title\":\"QA\"},{\"@type\":[\"A\",\"B\"]}]}</script><script type='application/ld+json'>{broken</script>"
    mail = "Subject: Jobs\nContent-Type: text/plain\n\nsee https://a.example/1 and https://b.example/2 or https://a.example/1"
    spark.createDataFrame([(1, html, mail), (2, None, None), (3, "", "")], "id int, html string, mail string").createOrReplaceTempView("sql_pages")
    assert [tuple(r) for r in spark.sql("SELECT id, a.* FROM sql_pages, LATERAL page_anchors(html) a ORDER BY id, pos").collect()] == [(1, 0, "/1", "One more"), (1, 1, "/2", "T&wo"), (1, 2, "/3", "three")]
    ld = spark.sql("SELECT id, j.type, j.title FROM sql_pages, LATERAL json_ld(html) j ORDER BY id, pos").collect()
    assert [tuple(r) for r in ld] == [(1, "", None), (1, "JobPosting", "QA"), (1, "A,B", None)]
    assert [tuple(r) for r in spark.sql("SELECT id, m.subject, m.href FROM sql_pages, LATERAL mail_links(mail) m ORDER BY id, pos").collect()] == [(1, "Jobs", "https://a.example/1"), (1, "Jobs", "https://b.example/2")]
