"""Queries on literal rows whose answers are stated, and further ones on the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import compose, keywords, state, versions
from ..sources import landed, sinks
from .catalogue import _GATED, POST, SQL, case, literal, order_feeds, part_postings, query, read, scored_parts, sql_values

DAY = "2026-10-10"


def day():
    return F.lit(DAY).cast("date")


def stated(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {sql_values(rows)}) v({columns})"


# -- sources ------------------------------------------------------------------------------


@case(stated([(0, "QA Engineer"), (1, "Dev"), (2, "Data Analyst")], "pos, q"))
def o1_5_build_queries(spark, sf_dir):
    got = landed.build_queries(spark, ["QA  Engineer", "qa engineer", "Dev", " Data Analyst ", "DEV"], [])
    return literal(spark, list(enumerate(got)), "pos int, q string")


WP = json.dumps([{"id": 7, "date": "2026-10-01T00:00:00", "link": "https://b.example/qa-at-acme-labs/", "title": {"rendered": "QA | Lead | Acme"}, "content": {"rendered": "<p>Salary: Tk 20,000</p><p>2019-2023</p>"}, "metas": {"_job_location": '{"3":"Dhaka","4":"Savar"}', "_job_experience": "None", "_job_expiry_date": "2026-11-01"}}, {"id": 8, "date": "2026-10-02", "link": "https://b.example/tester-at-beta-works/", "title": {"rendered": "Tester"}, "content": {"rendered": ""}, "metas": {}}])


@case("SELECT title, company, location, \"salaryMin\"::int AS \"salaryMin\", deadline::date AS deadline FROM (VALUES ('QA | Lead', 'Acme', 'Dhaka, Savar', 20000, '2026-11-01'), ('Tester', 'Beta Works', 'Dhaka, Bangladesh', NULL, NULL)) v(title, company, location, \"salaryMin\", deadline)")
def o1_19_wordpress(spark, sf_dir):
    """O1.18 to O1.21."""
    return landed.wordpress(literal(spark, [("u", WP)], "url string, body string"), day()).select("title", "company", "location", "salaryMin", "deadline")


CAREERS = '<a href="/jobs/qa-engineer">QA Engineer</a><a href="/about">Our engineers</a><a href="/jobs/x">Jobs</a><a href="https://c.example/careers/data-analyst"><b>Data Analyst</b></a><a href="/jobs/senior-officer-1">Officer, Accounts</a>'


@case(stated([("QA Engineer", "Firm"), ("Data Analyst", "Firm"), ("Officer, Accounts", "Firm")], "title, company"))
def o1_24_careers(spark, sf_dir):
    return landed.careers(literal(spark, [("https://c.example", CAREERS)], "url string, body string"), day(), "Firm").select("title", "company")


CARDS = '<div class="card"><a href="/job?id=1">One</a></div><div class="card hot"><a href="/job?id=2">Two</a><a href="/job?id=2">Again</a></div>'


@case(stated([("/job?id=1", "One", "card"), ("/job?id=2", "Two", "card hot")], "href, text, css"))
def o1_22_cards(spark, sf_dir):
    """O1.22, O1.30, O6.2."""
    return landed.cards(literal(spark, [("u", CARDS)], "url string, body string"), "id=").select("href", "text", "css")


@case(stated([("card", 1), ("card hot", 1)], "css, n"))
def o1_30_probe(spark, sf_dir):
    return landed.probe(landed.cards(literal(spark, [("u", CARDS)], "url string, body string"), "id="))


MAIL = "Subject: alert\nContent-Type: text/html\n\n<p><a href='https://b.example/job/9?x=1'>QA Engineer</a></p><p>Acme</p><p>Banani, Dhaka</p>"


@case(stated([("QA Engineer", "Acme", "Banani, Dhaka", "https://b.example/job/9")], "title, company, location, url"))
def o1_25_mail(spark, sf_dir):
    """O1.25, O1.26."""
    m = literal(spark, [("m", MAIL)], "path string, content string").select("path", F.col("content").cast("binary").alias("content"))
    return landed.mail_alerts(m, day(), "/job/").select("title", "company", "location", "url")


@case(stated([("Salary: Tk 5,000 Pay is negotiable",)], "pay"))
def o1_31_pay_lines(spark, sf_dir):
    return literal(spark, [("x 2019-2023\nSalary: Tk 5,000\nnone\nPay is negotiable",)], "t string").select(parse.pay_text(F.col("t")).alias("pay"))


ADDRESSES = [('{"jobLocation":{"address":{"streetAddress":"Road 1, Banani","addressLocality":"Banani","addressRegion":"Dhaka"}}}', "Road 1, Banani, Dhaka"), ('{"jobLocation":[{"address":{"addressLocality":"N/A","addressRegion":"Dhaka"}}],"jobLocationType":"TELECOMMUTE"}', "Remote, Dhaka"), ('{"jobLocation":"Sylhet"}', "Sylhet"), ("{}", "")]


@case(stated([(i, w) for i, (_, w) in enumerate(ADDRESSES)], "i, place"))
def o1_15_ld_location(spark, sf_dir):
    return literal(spark, [(i, a) for i, (a, _) in enumerate(ADDRESSES)], "i int, item string").select("i", landed.ld_location(F.col("item")).alias("place"))


@case("SELECT i, pay::int AS pay FROM (VALUES (0, 30000), (1, 50000), (2, NULL), (3, NULL), (4, NULL)) v(i, pay)")
def o1_17_monthly_pay(spark, sf_dir):
    d = literal(spark, [(0, 30000.0, "MONTH", "BDT"), (1, 600000.0, "YEAR", "BDT"), (2, 300.0, "HOUR", "BDT"), (3, 500.0, "MONTH", "USD"), (4, 0.0, "", "BDT")], "i int, v double, u string, c string")
    return d.select("i", parse.monthly_pay(F.col("v"), F.col("u"), F.col("c")).alias("pay"))


# -- projections and predicates --------------------------------------------------------------


@query("SELECT p_partkey AS seq, CASE WHEN trim(p_name) <> '' THEN p_name END AS title, 'Tejgaon' AS area FROM part WHERE trim(p_name) <> '' AND trim(p_brand) <> ''")
def o3_1_enrich(spark, sf_dir):
    """O3.1 on parts, all at one place."""
    p = part_postings(spark, sf_dir).withColumns({"location": F.lit("Tejgaon, Dhaka"), "employmentType": F.lit("")})
    return landed.enrich(p).select("seq", "title", "area")


@query(f"SELECT seq, priority FROM ({_GATED}) WHERE priority IN ('A', 'B') AND seq % 3 = 0")
def o3_4_select_for_notice(spark, sf_dir):
    p = scored_parts(spark, sf_dir)
    return state.select_for_notice(p, p.where("seq % 3 = 0").select("fingerprint"), "B").select("seq", "priority")


@query("SELECT o_orderkey, (o_orderstatus = 'F' OR ((o_orderdate::date + 30 >= DATE '1998-01-01') AND o_orderdate::date >= DATE '1998-01-01' - 45)) AS stays FROM orders")
def o3_5_retention(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Saved").otherwise("Rejected").alias("status"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("deadline"), F.col("o_orderdate").cast("date").alias("createdAt"))
    return o.select("o_orderkey", state.still_relevant(F.lit("1998-01-01").cast("date")).alias("stays"))


@query("SELECT p_partkey, array_to_string(list_filter([p_brand, CASE WHEN p_size > 25 THEN p_type END, ''], lambda x: x IS NOT NULL AND x <> ''), ' | ') AS facts FROM part")
def o3_7_facts(spark, sf_dir):
    """O3.7, O9.47."""
    return read(spark, sf_dir, "part").select("p_partkey", compose.joined([F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")), F.lit("")]).alias("facts"))


@query("SELECT conv_id::varchar || '-' || turn AS id FROM conversations WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1")
def o9_38_valid_versions(spark, sf_dir):
    """O3.10, O9.38, O9.40."""
    c = read(spark, sf_dir, "conversations").where("text <> ''")
    v = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").alias("appliedAt"), F.col("conv_id").cast("string").alias("jobId"), F.lit("").alias("jobFingerprint"), F.col("text").alias("seq"))
    return versions.valid_versions(v).select("id")


@query("SELECT c_custkey AS id, c_mktsegment AS p FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal > 0")
def o3_11_split_private(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("p"))
    return versions.split_private(c, ["p"])[1]


# -- joins, sorts, windows --------------------------------------------------------------------


@query("SELECT DISTINCT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey OR o_orderkey = c_custkey * 4")
def o4_16_versions_for(spark, sf_dir):
    """O4.16: a match by either of two keys, as two equality joins."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("jobId"), F.col("o_orderkey").cast("string").alias("jobFingerprint"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") * 4).cast("string").alias("fingerprint"))
    return versions.versions_for(o, c).select(F.col("id").alias("o_orderkey"), F.col("for_job").cast("bigint").alias("c_custkey"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 5 THEN NULL ELSE c_mktsegment END AS p, c_name AS q FROM customer")
def o4_19_with_private(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("p"), F.col("c_name").alias("q"))
    return versions.with_private(c, "id", 5, "p", F.lit(None).cast("string"))


@query(f'SELECT seq, rank::int AS rank FROM (SELECT seq, row_number() OVER (ORDER BY priority, "matchScore" DESC, seq) AS rank FROM ({_GATED})) WHERE rank <= 25')
def o7_1_feed_order(spark, sf_dir):
    """O7.1, O7.4: the first 25 of the feed (a report)."""
    top = state.feed_order(scored_parts(spark, sf_dir), "seq").limit(25).select("seq", F.monotonically_increasing_id().alias("i"))
    return top.select("seq", (F.col("i") + 1).cast("int").alias("rank"))


# -- keywords ---------------------------------------------------------------------------------


def post(spark):
    return literal(spark, [(1, "Engineer", POST)], "doc_id bigint, title string, text string")


def graded(spark):
    lex = keywords.lexicon_table(spark)
    return keywords.evidence(keywords.extract(post(spark), lex), lex, "Python, SQL and BSc", "wrote a test case")


@case(stated([("python", "skills"), ("sql", "skills"), ("test case", "prose"), ("docker", "none"), ("excel", "none"), ("bachelor's degree", "skills")], "key, evidence"))
def o9_14_evidence(spark, sf_dir):
    return graded(spark).select("key", "evidence")


@case("SELECT 1::bigint AS doc_id, 3::bigint AS found, 5::bigint AS total, 2::bigint AS \"mustFound\", 3::bigint AS \"mustTotal\", ['Docker', 'Excel'] AS missing")
def o5_10_coverage(spark, sf_dir):
    """O5.10, O5.11."""
    return keywords.coverage(graded(spark), "Python, SQL, test cases")


@case(stated([("required", 2, 5), ("tools", 2, 5)], "grp_name, matched, total"))
def o5_12_requirement_groups(spark, sf_dir):
    """O5.12, O9.22."""
    return keywords.requirement_groups(graded(spark)).select("grp_name", "matched", "total")


@case("SELECT 1::bigint AS doc_id, 'match' AS state")
def o9_21_education(spark, sf_dir):
    return keywords.compare_education(graded(spark))


@case(stated([("Design test cases and run Docker", 1)], "segment, n"))
def o9_18_responsibilities(spark, sf_dir):
    return keywords.responsibilities(post(spark), keywords.lexicon_table(spark)).select("segment", "n")


@case("SELECT 1::bigint AS doc_id, 'SQL, Excel' AS line")
def o9_19_labelled_line(spark, sf_dir):
    return keywords.labelled_line(keywords.segments(post(spark)), "skills")


@case(stated([(0, "match"), (1, "gap"), (2, "unknown"), (3, "match"), (4, "unknown")], "i, state"))
def o9_21_years(spark, sf_dir):
    d = literal(spark, list(enumerate(["1+ years", "5 years of work", "some experience", "Freshers welcome", "aged 22 to 30 years"])), "i int, t string")
    return d.select("i", keywords.compare_years(F.col("t"), 2).alias("state"))


@query("SELECT p_partkey, CASE WHEN p_size * 1000 >= 20000 THEN 'match' ELSE 'gap' END AS state FROM part")
def o9_21_salary(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", keywords.compare_salary(F.col("p_size") * 500, F.col("p_size") * 1000, 20000).alias("state"))


HEADS = [("Requirements", "required"), ("What you'll need", "required"), ("Nice to have", "preferred"), ("Key Responsibilities", "duties"), ("About Us", "ignore"), ("Skills: PHP", "required"), ("Location: Dhaka", None), ("we write code every day.", None), ("How we work", "ignore")]


@case(stated(HEADS, "t, section"))
def o9_7_headings(spark, sf_dir):
    """O9.6, O9.7."""
    d = literal(spark, [(t,) for t, _ in HEADS], "t string")
    return d.select("t", keywords.heading(F.col("t"), F.lit(False))["type"].alias("section"))


NORMS = [("Cross-Browser  Testing", "Cross Browser Testing"), ("UI / UX", "UI/UX"), ("it’s_ok", "it's ok"), ("", "")]


@case(stated(NORMS, "t, n"))
def o9_1_norm(spark, sf_dir):
    return literal(spark, [(t,) for t, _ in NORMS], "t string").select("t", keywords.norm(F.col("t")).alias("n"))


# -- composed texts ---------------------------------------------------------------------------


@query("SELECT p_partkey, 'resume_' || lower(replace(trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')), ' ', '-')) || '_' || lower(replace(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ', '-')) || '_2026-10-10.pdf' AS file FROM part")
def o9_30_file_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", compose.file_name(F.col("p_brand"), F.col("p_name"), day()).alias("file"))


@query("SELECT n_nationkey, CASE WHEN regexp_matches(lower(n_name), '^[aeiou]') THEN 'an' ELSE 'a' END AS article, strftime(DATE '2026-10-10', '%-d %b %Y') AS day FROM nation")
def o9_45_sentences(spark, sf_dir):
    """O9.43, O9.45."""
    return read(spark, sf_dir, "nation").select("n_nationkey", compose.article(F.col("n_name")).alias("article"), compose.shown_day(day()).alias("day"))


@query(f"SELECT array_to_string(list(line), chr(10)) AS \"table\", (SELECT count(*) FROM part) - 25 AS more, least(8, sum((n_notes > 0)::INT))::INT AS n_caveats FROM (SELECT '| ' || priority || ' | ' || seq || ' |' AS line, n_notes FROM ({_GATED}) ORDER BY seq LIMIT 25)")
def o2_6_digest(spark, sf_dir):
    """O2.6: the text of a notice (its first 25 rows) and its first caveats."""
    d = sinks.digest(scored_parts(spark, sf_dir), [F.col("seq")], 25, ("priority", "seq"))
    return d.select("table", "more", F.size("caveats").alias("n_caveats"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def o2_1_json_export(spark, sf_dir):
    """O2.1 to O2.3."""
    n = read(spark, sf_dir, "nation")
    return sinks.feed_json(n.select("n_nationkey", "n_name", "n_regionkey")).select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("n_nationkey"), "value")


@query(SQL["o10_4_ledger"].replace("SELECT coalesce(v.fingerprint, f.fingerprint) AS fingerprint, coalesce(v.created, f.created) AS first_seen", "SELECT coalesce(v.fingerprint, f.fingerprint) AS fingerprint, f.fingerprint IS NOT NULL AS notified").partition(", coalesce(v.status")[0] + " FROM prev v FULL JOIN fresh f ON v.fingerprint = f.fingerprint")
def o10_5_notified(spark, sf_dir):
    fresh, _, ledger = order_feeds(spark, sf_dir)
    return state.mark_notified(ledger, fresh).select("fingerprint", "notified")


