"""Queries of parsers, connectors and extraction on texts composed from the tables.

A part becomes a posting, a page, a feed item or a mail by fixed wording around its own name, brand,
size and number, so that what a parser should find is a plain expression of the same columns in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, parse, text
from ..operators import keywords
from ..sources import boards, fanin, landed
from .catalogue import SLUG, query, read, title_sql

AS_OF = "2026-10-10"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def chosen(key: str, options: list[Column]) -> Column:
    """One of the options by the remainder of a number."""
    out = options[-1]
    for i, x in list(enumerate(options))[-2::-1]:
        out = F.when(F.col(key) % len(options) == i, x).otherwise(out)
    return out


def said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def parts(spark, sf_dir) -> DataFrame:
    """Parts, dealt out to all tasks (a file of narrow rows is one split, and a text made of a row is much work);
    ``k`` is 10 to 59, by size."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read(spark, sf_dir, "part").repartition(tasks, "p_partkey").withColumn("k", F.col("p_size") + 9)


_PARTS = "(SELECT *, p_size + 9 AS k FROM part)"
_TITLE = "(['Urgent Hiring: ', 'Jr. ', 'Sr. (Remote) ', ''])[p_partkey % 4 + 1] || p_name || ([' for Fintech', ' / Sales', ' Engr'])[p_partkey % 3 + 1]"


@query(f"SELECT p_partkey, {title_sql(_TITLE)} AS norm FROM part")
def o8_6_normalize_title(spark, sf_dir):
    words = [chosen("p_partkey", [F.lit(x) for x in xs]) for xs in (["Urgent Hiring: ", "Jr. ", "Sr. (Remote) ", ""], [" for Fintech", " / Sales", " Engr"])]
    return parts(spark, sf_dir).select("p_partkey", text.normalize_title(F.concat(words[0], "p_name", words[1])).alias("norm"))


@query(f"""SELECT p_partkey, [k * 1000, k * 1000, 100000 + k * 1000, NULL, k * 1000, k * 1000][p_partkey % 6 + 1]::INT AS lo, [(k + 5) * 1000, NULL, NULL, NULL, (k + 5) * 1000, (k + 7) * 1000][p_partkey % 6 + 1]::INT AS hi,
 [printf('Tk %d,000 - %d,000', k, k + 5), printf('Tk %d,000', k), printf('Tk %d,000', 100 + k), 'Negotiable', printf('Tk %d,000 - %d,000', k, k + 5), printf('Tk %d,000 - %d,000', k, k + 7)][p_partkey % 6 + 1] AS label FROM {_PARTS}""")
def o8_8_parse_salary(spark, sf_dir):
    """O8.7, O8.8: ranges, either way round, single amounts with units, and pay that is not stated."""
    k = lambda n=0: (F.col("k") + n).cast("string")
    forms = [
        said("Tk. ", k(), ",000 - ", k(5), ",000 (Monthly)"), said("Salary: Tk ", k(), "k"), said("Tk. 1.", F.lpad(k(), 2, "0"), " lakh"), said("Negotiable for ", F.col("p_name")),
        said("Tk ", k(5), ",000 to Tk ", k(), ",000"), said("BDT ", k(), " thousand - ", k(7), " thousand"),
    ]
    p = parts(spark, sf_dir).withColumn("p", parse.parse_salary(chosen("p_partkey", forms)))
    return p.select("p_partkey", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), F.col("p.text").alias("label"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN DATE '{AS_OF}' - (o_orderkey % 20)::INT WHEN 6 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders")
def o8_10_parse_date(spark, sf_dir):
    """O8.10: dates of orders in several wordings, relative ones, and none."""
    at = lambda f: F.date_format("o_orderdate", f)
    forms = [at("dd MMM yyyy"), at("MMMM d, yyyy"), at("yyyy-MM-dd"), at("dd/MM/yyyy"), said("Deadline: ", at("d MMM yyyy")), said((F.col("o_orderkey") % 20).cast("string"), " days ago"), said("to be told")]
    return read(spark, sf_dir, "orders").select("o_orderkey", parse.parse_date(chosen("o_orderkey", forms), as_of()).alias("d"))


_NAMES = [*fixed.AREAS]
_AREAS = ", ".join(f"({i}, '{n}', {lat}, {lon})" for i, (n, (lat, lon)) in enumerate(fixed.AREAS.items()))
_KM = f"round({2 * fixed.EARTH_KM} * asin(sqrt(pow(sin((radians(lat) - radians({fixed.HOME[0]})) / 2), 2) + cos(radians({fixed.HOME[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {fixed.HOME[1]}) / 2), 2))), 1)"
_TITLED = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


@query(f"""WITH a(i, name, lat, lon) AS (VALUES {_AREAS}), l AS (SELECT p_partkey, 'House ' || p_size || ', ' || CASE WHEN p_partkey % 5 = 0 THEN 'Remote' WHEN p_partkey % 5 = 1 THEN p_name ELSE (SELECT upper(name) FROM a WHERE i = p_partkey % {len(_NAMES)}) END || ', Dhaka' AS loc FROM part),
h AS (SELECT *, ' ' || {SLUG.format("loc")} || ' ' AS hay FROM l),
b AS (SELECT p_partkey, arg_min(name, (-length(name), i)) AS name FROM h JOIN a ON contains(hay, ' ' || name || ' ') GROUP BY 1)
SELECT p_partkey, CASE WHEN b.name IS NOT NULL THEN {_TITLED("b.name")} WHEN p_partkey % 5 = 0 THEN 'Remote' ELSE 'Dhaka (area not stated)' END AS area, CASE WHEN b.name IS NOT NULL THEN {_KM} WHEN p_partkey % 5 = 0 THEN 0 END AS km, p_partkey % 5 = 0 AS remote
FROM h LEFT JOIN b USING (p_partkey) LEFT JOIN a ON a.name = b.name""")
def o8_12_resolve_area(spark, sf_dir):
    """O8.12, O4.20, O7.3: places of parts, some remote, some in no known area."""
    name = F.get(F.array(*[F.lit(n.upper()) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    place = F.when(F.col("p_partkey") % 5 == 0, "Remote").when(F.col("p_partkey") % 5 == 1, F.col("p_name")).otherwise(name)
    p = parts(spark, sf_dir).withColumn("p", parse.resolve_area(said("House ", F.col("p_size").cast("string"), ", ", place, ", Dhaka"), F.lit("")))
    return p.select("p_partkey", F.col("p.area").alias("area"), F.col("p.km").alias("km"), F.col("p.remote").alias("remote"))


_LANDS = ["London, UK", "Singapore", "Dhaka, Bangladesh", "Berlin, Germany", "Bucharest, Romania", "Tokyo, Japan", "UAE office, Sylhet"]
_FOUND = f"regexp_extract(loc, '(?i)\\b({fixed.ABROAD})\\b', 1)"


@query(f"SELECT p_partkey, CASE WHEN {_FOUND} <> '' AND NOT regexp_matches(loc, '(?i)\\b({fixed.HOME_COUNTRY.replace(chr(39), chr(39) * 2)})\\b') THEN CASE WHEN length({_FOUND}) <= 3 THEN upper({_FOUND}) ELSE {_TITLED(f'lower({_FOUND})')} END END AS country FROM (SELECT p_partkey, p_name || ', ' || ({_LANDS!r})[p_partkey % 7 + 1] AS loc FROM part)")
def o3_9_foreign_country(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", parse.foreign_country(said(F.col("p_name"), ", ", chosen("p_partkey", [F.lit(x) for x in _LANDS]))).alias("country"))


_KINDS = [("SQA Engineer", "", "Software Quality Assurance"), ("Management Trainee Officer", "", "Management & Business"), ("Commission Agent", "mission driven", "Information Technology"), ("MIS Officer", "", "MIS"), ("PHP Developer", "laravel", "Software Development"), ("IT Support", "network server", "Information Technology")]


@query(f"SELECT p_partkey, ({[c for _, _, c in _KINDS]!r})[p_partkey % 6 + 1] AS category FROM part")
def o8_9_category(spark, sf_dir):
    """O8.9, O5.7: titles of six kinds with parts' names in their texts."""
    title, body = (chosen("p_partkey", [F.lit(k[i]) for k in _KINDS]) for i in (0, 1))
    return parts(spark, sf_dir).select("p_partkey", parse.infer_category(title, said(body, " ", F.col("p_name"))).alias("category"))


_ROLES = [("SQA Engineer", True), ("Software Quality Assurance Lead", True), ("Management Consultant", False), ("Data Operations Analyst", True), ("Driver", False)]


@query(f"SELECT p_partkey, ({[ok for _, ok in _ROLES]!r})[p_partkey % 5 + 1] AS ok FROM part")
def o3_2_relevance(spark, sf_dir):
    """O3.2, O7.8."""
    title = said(chosen("p_partkey", [F.lit(t) for t, _ in _ROLES]), " ", F.col("p_name"))
    return parts(spark, sf_dir).select("p_partkey", parse.is_relevant(title, ["software quality assurance", "junior data analyst", "management trainee"]).alias("ok"))


@query("SELECT p_partkey, 'Salary: Tk ' || p_size || ',000' || CASE WHEN p_partkey % 2 = 0 THEN ' Our pay is negotiable' ELSE '' END AS pay FROM part")
def o1_31_pay_lines(spark, sf_dir):
    lines = said(F.col("p_name"), " 2019-2023\nSalary: Tk ", F.col("p_size").cast("string"), ",000\nnone", F.when(F.col("p_partkey") % 2 == 0, "\nOur pay is negotiable").otherwise(""))
    return parts(spark, sf_dir).select("p_partkey", parse.pay_text(lines).alias("pay"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN round_even(p_retailprice, 0) WHEN 1 THEN round_even(p_retailprice * 100 / 12, 0) WHEN 4 THEN round_even(p_retailprice, 0) END::INT AS pay FROM part")
def o1_17_monthly_pay(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 5 == 1, F.col("p_retailprice") * 100).otherwise(F.col("p_retailprice"))
    unit, money = (chosen("p_partkey", [F.lit(x) for x in xs]) for xs in (["MONTH", "YEAR", "HOUR", "MONTH", ""], ["BDT", "BDT", "BDT", "USD", ""]))
    return parts(spark, sf_dir).select("p_partkey", parse.monthly_pay(value, unit, money).alias("pay"))


# -- connectors --------------------------------------------------------------------------


def _ld(p: DataFrame) -> Column:
    """A page with one JobPosting of a part, in a graph."""
    address = F.struct(F.concat(F.lit("Road "), F.col("p_size").cast("string"), F.lit(", Banani")).alias("streetAddress"), F.lit("Banani").alias("addressLocality"), F.lit("Dhaka").alias("addressRegion"))
    pay = F.struct(F.lit("BDT").alias("currency"), F.struct((F.col("k") * 12000).alias("minValue"), F.when(F.col("p_partkey") % 2 == 0, F.col("k") * 24000).alias("maxValue"), F.lit("YEAR").alias("unitText")).alias("value"))
    job = F.struct(
        F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization"), F.struct(address.alias("address")).alias("jobLocation"),
        F.when(F.col("p_partkey") % 3 == 0, "TELECOMMUTE").alias("jobLocationType"), F.lit("FULL_TIME").alias("employmentType"), F.lit("2026-10-01").alias("datePosted"), F.date_add(F.lit("2026-10-20").cast("date"), F.col("p_size")).cast("string").alias("validThrough"), pay.alias("baseSalary"), F.lit("x").alias("description"),
    )
    return F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), F.to_json(job), F.lit("]}</script></html>"))


def _url(p: str = "job") -> Column:
    return said(f"https://a.example/{p}/", F.col("p_partkey").cast("string"))


_PLACE = "CASE WHEN p_partkey % 3 = 0 THEN 'Remote, ' ELSE '' END || 'Road ' || p_size || ', Banani, Dhaka'"


@query(f"SELECT p_name AS title, p_brand AS company, {_PLACE} AS location, 'Full time' AS \"employmentType\", (k * 1000)::INT AS \"salaryMin\", CASE WHEN p_partkey % 2 = 0 THEN k * 2000 END::INT AS \"salaryMax\", DATE '2026-10-01' AS \"postedAt\", (DATE '2026-10-20' + p_size)::DATE AS deadline, 'https://a.example/job/' || p_partkey AS url FROM {_PARTS}")
def o1_10_jsonld(spark, sf_dir):
    """O1.10, O1.11, O1.13, O1.14, O1.16: a page of JSON-LD for each part."""
    p = parts(spark, sf_dir)
    pages = p.select(_url().alias("url"), _ld(p).alias("body"))
    return landed.jsonld(pages, as_of()).select("title", "company", "location", "employmentType", "salaryMin", "salaryMax", "postedAt", "deadline", "url")


@query(f"SELECT p_partkey, {_PLACE} AS place FROM part")
def o1_15_ld_location(spark, sf_dir):
    p = parts(spark, sf_dir)
    items = landed.ld_blocks(p.select(F.col("p_partkey").cast("string").alias("url"), _ld(p).alias("body")))
    return items.select(F.col("url").cast("bigint").alias("p_partkey"), landed.ld_location(F.col("item")).alias("place"))


_FEED = "SELECT *, p_partkey % 4 AS r FROM part"


def _feeds(spark, sf_dir) -> DataFrame:
    """Feeds with an item for each part; every fourth is of another region."""
    region = F.get(F.array(F.lit(""), F.lit("<region>Asia</region>"), F.lit("<region>South Asia</region>"), F.lit("<region>Mars</region>")), (F.col("p_partkey") % 4).cast("int"))
    item = said("<item><title>", F.col("p_brand"), ": ", F.col("p_name"), "</title><link>https://b.example/", F.col("p_partkey").cast("string"), "</link><author>A</author>", region, "<description>&lt;p&gt;Tk ", F.col("k").cast("string"), ",000&lt;/p&gt;</description></item>")
    return parts(spark, sf_dir).select(F.col("p_brand").alias("url"), said("<rss>", item, "</rss>").alias("body"))


@query(f"SELECT p_name AS title, p_brand AS company, CASE r WHEN 0 THEN 'Remote' ELSE 'Asia' END AS location, (p_size + 9) * 1000 AS \"salaryMin\", 'https://b.example/' || p_partkey AS url FROM ({_FEED}) WHERE r < 3")
def o1_8_rss(spark, sf_dir):
    """O1.8, O1.9, O3.3: an item for each part; items of other regions go."""
    found = landed.rss(_feeds(spark, sf_dir), as_of(), regions=["asia"], title_format="company: role")
    return found.select("title", "company", F.replace("location", F.lit("South "), F.lit("")).alias("location"), "salaryMin", "url")


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_name AS q FROM region")
def o1_5_build_queries(spark, sf_dir):
    """O1.5: search terms from a short configured list (regions, said twice)."""
    names = [r["r_name"] for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # a configuration
    got = landed.build_queries(spark, [*names, *(f" {n.lower()} " for n in names)], [])
    return spark.createDataFrame(list(enumerate(got)), "pos long, q string")


@query(f"SELECT p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Acme Labs' END AS company, CASE WHEN p_partkey % 3 = 0 THEN 'Dhaka, Savar' ELSE 'Dhaka, Bangladesh' END AS location, (k * 1000)::INT AS \"salaryMin\", DATE '2026-11-01' AS deadline FROM {_PARTS}")
def o1_19_wordpress(spark, sf_dir):
    """O1.18 to O1.21: a page of a REST listing for each part."""
    title = F.when(F.col("p_partkey") % 2 == 0, said(F.col("p_name"), " | ", F.col("p_brand"))).otherwise(F.col("p_name"))
    metas = F.map_from_arrays(F.array(F.lit("_job_expiry_date"), F.lit("_job_location"), F.lit("_job_salary")), F.array(F.lit("2026-11-01"), F.when(F.col("p_partkey") % 3 == 0, '{"3":"Dhaka","4":"Savar"}').otherwise("none"), said("Tk ", F.col("k").cast("string"), ",000")))
    item = F.struct(F.col("p_partkey").alias("id"), F.lit("2026-10-01T00:00:00").alias("date"), F.lit("https://b.example/x-at-acme-labs/").alias("link"), F.struct(title.alias("rendered")).alias("title"), F.struct(F.lit("<p>2019-2023</p>").alias("rendered")).alias("content"), metas.alias("metas"))
    pages = parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("url"), F.to_json(F.array(item)).alias("body"))
    return landed.wordpress(pages, as_of()).select("title", "company", "location", "salaryMin", "deadline")


@query("SELECT 'QA Engineer ' || p_name AS title, 'https://c.example/jobs/qa-' || p_partkey AS url FROM part")
def o1_24_careers(spark, sf_dir):
    """O1.24: of three links of each part's page one is an opening."""
    key = F.col("p_partkey").cast("string")
    body = said('<a href="https://c.example/jobs/qa-', key, '">QA Engineer ', F.col("p_name"), '</a><a href="/about">Our engineers</a><a href="/jobs/', key, '">Jobs</a>')
    return landed.careers(parts(spark, sf_dir).select(said("https://c.example/", key).alias("url"), body.alias("body")), as_of(), "Firm").select("title", "url")


def _cards(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    body = said('<div class="card ', F.lower("p_type"), '"><a href="/job?id=', key, '">', F.col("p_name"), '</a><a href="/job?id=', key, '">Again</a><a href="/other">No</a></div>')
    return landed.cards(parts(spark, sf_dir).select(key.alias("url"), body.alias("body")), "id=")


@query("SELECT '/job?id=' || p_partkey AS href, p_name AS text, 'card ' || lower(p_type) AS css FROM part")
def o1_22_cards(spark, sf_dir):
    """O1.22, O6.2."""
    return _cards(spark, sf_dir).select("href", "text", "css")


@query("SELECT 'card ' || lower(p_type) AS css, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, css LIMIT 12")
def o1_30_probe(spark, sf_dir):
    """O1.30: the commonest block classes (a report)."""
    return landed.probe(_cards(spark, sf_dir))


@query("SELECT 'Engineer ' || p_name AS title, p_brand AS company, 'Banani, Dhaka' AS location, 'https://b.example/job/' || p_partkey AS url FROM part")
def o1_25_mail(spark, sf_dir):
    """O1.25, O1.26: an alert mail for each part."""
    key = F.col("p_partkey").cast("string")
    raw = said("Subject: alert\nContent-Type: text/html\n\n<p><a href='https://b.example/job/", key, "?x=1'>Engineer ", F.col("p_name"), "</a></p><p>", F.col("p_brand"), "</p><p>Banani, Dhaka</p>")
    mails = parts(spark, sf_dir).select(key.alias("path"), raw.cast("binary").alias("content"))
    return landed.mail_alerts(mails, as_of(), "/job/").select("title", "company", "location", "url")


_SELECTORS = {"card": "div.card, li.row", "title": "h2 a", "company": ".firm", "location": "span#place", "deadline": ".until", "link_contains": "/job/"}


def _board(spark, sf_dir) -> DataFrame:
    """Search pages with a part each, in two layouts, beside what is no card."""
    key, k = F.col("p_partkey").cast("string"), F.col("k").cast("string")
    inner = said('<h2><a href="/job/', key, '?utm_source=x">Engineer ', F.col("p_name"), '</a></h2><span class="firm">', F.col("p_brand"), " <b>Ltd</b></span>", F.when(F.col("p_partkey") % 2 == 0, '<span id="place">Banani</span>').otherwise(""), '<p class="until">30 Oct 2026</p><p>Salary: Tk ', k, ",000</p>")
    card = F.when(F.col("p_partkey") % 3 == 0, said('<ul><li class="row hot">', inner, "</li></ul>")).otherwise(said('<div class="card">', inner, "</div>"))
    pages = parts(spark, sf_dir).select(said("https://b.example/s?q=", key).alias("url"), said('<body><div class="card"><a href="/x">Hi</a></div>', card, "</body>").alias("body"))
    return boards.board(pages, as_of(), _SELECTORS, "Own")


@query(f"SELECT 'Engineer ' || p_name AS title, p_brand || ' Ltd' AS company, CASE WHEN p_partkey % 2 = 0 THEN 'Banani' ELSE 'Dhaka, Bangladesh' END AS location, DATE '2026-10-30' AS deadline, k * 1000 AS \"salaryMin\", 'https://b.example/job/' || p_partkey || '?utm_source=x' AS url FROM {_PARTS}")
def o1_22_board(spark, sf_dir):
    """O1.22, O8.17: cards of a board by selectors."""
    return _board(spark, sf_dir).select("title", "company", "location", "deadline", "salaryMin", "url")


@query(f"SELECT 'https://b.example/job/' || p_partkey || '?utm_source=x' AS url, CASE WHEN p_partkey % 5 = 0 THEN true ELSE false END AS longer, k * 1000 AS \"salaryMin\" FROM {_PARTS}")
def o1_23_details(spark, sf_dir):
    """O1.23: detail pages of every fifth posting, with texts of thousands of words, say more than their cards."""
    key = F.col("p_partkey").cast("string")
    page = said("<body><header>h</header><div class='job'>", F.repeat(said("duties of ", F.col("p_name"), ", "), 900), "<p>Tk 90,000</p></div></body>")
    details = parts(spark, sf_dir).where("p_partkey % 5 = 0").select(said("https://b.example/job/", key, "?utm_source=x").alias("url"), page.alias("body"))
    more = boards.with_details(_board(spark, sf_dir), details, "div.job", most_chars=None)
    return more.select("url", (F.length("description") > 12_000).alias("longer"), "salaryMin")


@query("SELECT * FROM (SELECT 'boards' AS source, count(*) AS found, NULL::BIGINT AS raw, 0 AS n_errors FROM part UNION ALL SELECT 'feed', count(*) FILTER (p_partkey % 4 < 3), count(*), 1 FROM part UNION ALL SELECT 'broken', 0, NULL, 1 UNION ALL SELECT 'nowhere', 0, NULL, 1)")
def o1_4_fan_in(spark, sf_dir):
    """O1.1, O1.4, O1.8, O5.4: the report of a run with a board, a feed with its raw count and a message, a source
    that fails while it runs, one that is unknown and one that is off."""
    feeds = _feeds(spark, sf_dir)
    fail = parts(spark, sf_dir).select(F.raise_error(F.lit("down")).cast("string").alias("title"))
    sources = {
        "boards": lambda own, queries: (_board(spark, sf_dir), None, []), "feed": lambda own, queries: (landed.rss(feeds, as_of(), regions=own["regions"]), landed.rss_raw(feeds), ["slow"]),
        "broken": lambda own, queries: (fail, None, []), "off": lambda own, queries: (fail, None, []),
    }
    config = {"boards": True, "feed": {"regions": ["asia"]}, "broken": True, "nowhere": True, "off": False}
    _, report = fanin.collect(spark, config, sources, [], {"feed": True})
    return report.select(F.col("discoveredBy").alias("source"), "found", "raw", F.size("errors").alias("n_errors"))


@query("SELECT 'Engineer ' || p_name AS title, 'site ' || (p_partkey % 2) AS source, 'https://s' || (p_partkey % 2) || '.example/' || p_partkey AS url FROM part WHERE p_partkey % 7 > 0")
def o1_12_sites(spark, sf_dir):
    """O1.12: JSON-LD of two sites' pages, one for each query; a title that no query of run or site fits goes."""
    p = parts(spark, sf_dir).withColumn("site", (F.col("p_partkey") % 2).cast("string"))
    name = F.when(F.col("p_partkey") % 7 == 0, said("Cook ", F.col("p_name"))).otherwise(said("Engineer ", F.col("p_name")))
    job = F.struct(F.lit("JobPosting").alias("@type"), name.alias("title"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization"), said("https://s", F.col("site"), ".example/", F.col("p_partkey").cast("string")).alias("url"), F.lit("x").alias("description"))
    block = said('<script type="application/ld+json">', F.to_json(job), "</script>")
    body = p.groupBy("site", F.pmod(F.xxhash64("p_partkey"), F.lit(8)).alias("n")).agg(F.array_join(F.collect_list(block), "").alias("body"))  # pages of a site
    pages = body.select(said("https://s", F.col("site"), ".example/", F.when(F.col("n") == 0, "engineer").otherwise(F.col("n").cast("string"))).alias("url"), "body")
    sites = [{"url": f"https://s{s}.example/{{query}}", "label": f"site {s}", "queries": ["engineer", *map(str, range(1, 8))]} for s in (0, 1)]
    found, _, _ = fanin.jsonld_sites(pages, as_of(), sites, ["engineer"])
    return found.select("title", "source", "url")


# -- extraction: a post for each part ------------------------------------------------------

#: A post asks for 1 to 5 years; every second has a line of skills, every third asks for a degree.
_SKILLED, _DEGREE = "p_partkey % 2 = 0", "p_partkey % 3 = 0"


def posts(spark, sf_dir) -> DataFrame:
    body = said(
        "Key Responsibilities\nDesign test cases for ", F.col("p_name"), " and run Docker\nRequirements\n", (F.col("p_size") % 5 + 1).cast("string"), "+ years of Python experience\nDocker is a plus\n",
        F.when(F.expr(_SKILLED), "Skills: SQL, Excel\n").otherwise(""), F.when(F.expr(_DEGREE), "BSc in CSE\n").otherwise(""), "About Us\nWe use Kubernetes",
    )
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.lit("Engineer").alias("title"), body.alias("text"))


_KEYS = [("python", "must", "true", "skills"), ("test case", "important", "true", "prose"), ("docker", "important", "true", "none"), ("sql", "must", _SKILLED, "skills"), ("excel", "must", _SKILLED, "none"), ("bachelor''s degree", "must", _DEGREE, "skills")]
_FOUND_KEYS = " UNION ALL ".join(f"SELECT p_partkey AS doc_id, '{k}' AS key, '{t}' AS tier, '{e}' AS evidence, {'p_size % 5 + 1' if k == 'python' else 'NULL::INT'} AS years FROM part WHERE {w}" for k, t, w, e in _KEYS)


@query(f"SELECT doc_id, key, tier, years FROM ({_FOUND_KEYS})")
def o9_13_extract(spark, sf_dir):
    """O9.5 to O9.10, O9.13, O6.5, O5.8."""
    return keywords.extract(posts(spark, sf_dir), keywords.lexicon_table(spark)).select("doc_id", "key", "tier", F.col("yearsRequired").alias("years"))


def graded(spark, sf_dir) -> DataFrame:
    lex = keywords.lexicon_table(spark)
    return keywords.evidence(keywords.extract(posts(spark, sf_dir), lex), lex, "Python, SQL and BSc", "wrote a test case")


@query(f"SELECT doc_id, key, evidence FROM ({_FOUND_KEYS})")
def o9_14_evidence(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "key", "evidence")


_PLAIN = f"SELECT * FROM ({_FOUND_KEYS}) WHERE key <> 'bachelor''s degree'"


@query(f"SELECT doc_id, count(*) FILTER (key IN ('python', 'sql', 'test case')) AS found, count(*) AS total, count(*) FILTER (tier = 'must' AND key IN ('python', 'sql')) AS \"mustFound\", count(*) FILTER (tier = 'must') AS \"mustTotal\", array_to_string(list_sort(list(CASE key WHEN 'docker' THEN 'Docker' ELSE 'Excel' END) FILTER (key IN ('docker', 'excel'))), ', ') AS missing FROM ({_PLAIN}) GROUP BY 1")
def o5_10_coverage(spark, sf_dir):
    """O5.10, O5.11."""
    return keywords.coverage(graded(spark, sf_dir), "Python, SQL, test cases").withColumn("missing", F.array_join("missing", ", "))


@query(f"SELECT doc_id, unnest(['required', 'tools']) AS grp_name, count(*) FILTER (evidence = 'skills') AS matched, count(*) AS total FROM ({_PLAIN}) GROUP BY 1")
def o5_12_requirement_groups(spark, sf_dir):
    """O5.12, O9.22."""
    return keywords.requirement_groups(graded(spark, sf_dir)).select("doc_id", "grp_name", "matched", "total")


@query(f"SELECT p_partkey AS doc_id, 'match' AS state FROM part WHERE {_DEGREE}")
def o9_21_education(spark, sf_dir):
    return keywords.compare_education(graded(spark, sf_dir))


@query("SELECT p_partkey AS doc_id, 'Design test cases for ' || p_name || ' and run Docker' AS segment, 1 AS n FROM part")
def o9_18_responsibilities(spark, sf_dir):
    return keywords.responsibilities(posts(spark, sf_dir), keywords.lexicon_table(spark)).select("doc_id", "segment", "n")


@query(f"SELECT p_partkey AS doc_id, 'SQL, Excel' AS line FROM part WHERE {_SKILLED}")
def o9_19_labelled_line(spark, sf_dir):
    return keywords.labelled_line(keywords.segments(posts(spark, sf_dir)), "skills")


@query("SELECT p_partkey, (['match', 'unknown', 'unknown'])[p_partkey % 3 + 1] AS state FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'match' ELSE 'gap' END FROM part WHERE p_partkey % 4 = 0")
def o9_21_years(spark, sf_dir):
    """O9.21: years a part's size says against twenty, freshers, ages and nothing."""
    other = chosen("p_partkey", [F.lit("Freshers welcome"), F.lit("aged 22 to 30 years"), F.lit("some experience")])
    asks = F.when(F.col("p_partkey") % 4 == 0, said(F.col("p_size").cast("string"), " years of ", F.col("p_name"))).otherwise(other)
    return parts(spark, sf_dir).select("p_partkey", keywords.compare_years(asks, 20).alias("state"))


_HEADS = [("Requirements", "required"), ("What you'll need", "required"), ("Nice to have", "preferred"), ("Key Responsibilities", "duties"), ("About Us", "ignore")]


@query(f"SELECT p_partkey, section FROM part JOIN (VALUES {', '.join(f'({i}, {s!r})' for i, (_, s) in enumerate(_HEADS))}) v(i, section) ON i = p_partkey % 6 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 6 = 5")
def o9_7_headings(spark, sf_dir):
    """O9.6, O9.7: headings, and parts' names in a sentence, which are none."""
    line = chosen("p_partkey", [*[F.lit(h) for h, _ in _HEADS], said("we write ", F.col("p_name"), " every day.")])
    return parts(spark, sf_dir).select("p_partkey", keywords.heading(line, F.lit(False))["type"].alias("section"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[‘’]', '''', 'g'), '\\s*/\\s*', '/', 'g'), '[\\s\\-‐-―_]+', ' ', 'g')) AS n FROM documents")
def o9_1_norm(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", keywords.norm(F.col("text")).alias("n"))


