"""All registered queries of the library and the SQL they are held against.

A query is named after the operators it exercises.  Tables without pay, dates or postings of
their own take a role by the mapping in the docstrings.  Literal rows are cases for the tests only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, parse, text
from ..operators import dedupe, keywords, resolution, scoring, state, versions
from ..operators.graph import components, new_path
from ..sources import fanin, landed, notices, sinks
from ..sources.buckets import BucketTable
from ..streaming import retention

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL it is held against."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: Small cases with stated answers: not registered, held against their SQL in the tests.
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def case(sql: str):
    def add(fn):
        CASES[fn.__name__] = (fn, sql)
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# -- SQL pieces shared by several oracles ------------------------------------------------

ACCENTS = "strip_accents(lower(coalesce({0}, '')))"
SLUG = "trim(regexp_replace(regexp_replace(" + ACCENTS + ", '[^a-z0-9+#./ ]', ' ', 'g'), ' +', ' ', 'g'))"
COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
MAP = lambda table, x: "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}[" + x + "], " + x + ")"
EXPAND = "array_to_string(list_transform(string_split(" + SLUG + ", ' '), lambda w: " + MAP(fixed.ABBREVIATIONS, "w") + "), ' ')"
NOISE = "regexp_replace({0}, '\\b(" + fixed.TITLE_NOISE + ")\\b', ' ', 'g')"
_T1 = SLUG.format("regexp_replace(regexp_replace(coalesce({0}, ''), '\\(.*?\\)', ' ', 'g'), '^[^:]{{0,24}}:\\s*', '')")
_T2 = "regexp_replace(regexp_replace(" + NOISE.replace("{0}", _T1) + ", '\\bfor\\b.*$', ' '), '[-/|,]+', ' ', 'g')"
TITLE = COLLAPSE.replace("{0}", EXPAND.replace("{0}", _T2))
TITLE = TITLE.replace("{{0,24}}", "{0,24}")
_C1 = SLUG.format("regexp_replace(coalesce({0}, ''), '\\(.*?\\)', ' ', 'g')")
COMPANY = "CASE WHEN {c} <> '' THEN {c} ELSE {s} END"
WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9+#]+')"


def title_sql(x: str) -> str:
    return TITLE.replace("{0}", x)


# -- text -------------------------------------------------------------------------------


@query("SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*) AS n_pages FROM pages GROUP BY 1")
def entry_pages_by_host(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("n_pages"))


_HTML = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<br\\s*/?>|</p>|</li>|</div>|</tr>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
_ENT = _HTML
for _e, _c in text.ENTITIES.items():
    _ENT = f"replace({_ENT}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_ENT}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM pages")
def o8_1_strip_html(spark, sf_dir):
    """O8.1, O8.2 on pages."""
    return read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query(f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def o8_3_slug(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(f"SELECT conv_id, turn, list_distinct_ordered AS terms FROM (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9+#./ ]', ' ', 'g'), ' +'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(fixed.STOP_WORDS)}, w)) AS l FROM conversations))")
def o8_13_terms(spark, sf_dir):
    """Tokeniser of terms on conversations."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.terms(F.col("text")).alias("terms"))


@query(f"SELECT p_partkey, array_to_string(list_transform({WORDS.format('p_name')}, lambda w: {MAP(fixed.SCORE_ABBREVIATIONS, 'w')}), ' ') AS words FROM part")
def o8_14_words(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.words(F.col("p_name"), True), " ").alias("words"))


TITLES = ["Urgent Hiring: SQA Engineer (Remote)", "Senior Software Engineer for Fintech Product", "MTO - Business / Sales", "Jr. QA Engineer", "Vacancy: Data Operations Analyst", "Engr, Dev & Admin", "", "Ünïcode Développer"]


@case(f"SELECT t AS title, {title_sql('t')} AS norm FROM (VALUES {sql_values([(t,) for t in TITLES])}) v(t)")
def o8_6_normalize_title(spark, sf_dir):
    return literal(spark, [(t,) for t in TITLES], "title string").select("title", text.normalize_title(F.col("title")).alias("norm"))


@query(f"SELECT p_partkey, {title_sql('p_name')} AS norm FROM part")
def o8_4_expand_part_titles(spark, sf_dir):
    """O8.4, O8.6 on names of parts."""
    return read(spark, sf_dir, "part").select("p_partkey", text.normalize_title(F.col("p_name")).alias("norm"))


_CNAME = f"trim(regexp_replace(regexp_replace(regexp_replace(translate({_C1}, './', '  '), '\\b({fixed.COMPANY_NOISE})\\b', ' ', 'g'), '\\bthe\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def company_sql(x: str) -> str:
    c, s = _CNAME.replace("{0}", x), SLUG.format(x)
    return f"CASE WHEN {c} <> '' THEN {c} ELSE {s} END"


@query(f"SELECT s_suppkey, {company_sql('s_name')} AS company FROM supplier")
def o8_5_normalize_company(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.normalize_company(F.col("s_name")).alias("company"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words, length(coalesce(text, '')) AS chars, regexp_extract(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email FROM documents")
def o5_14_counts_and_email(spark, sf_dir):
    """O5.14, O9.33."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("words"), F.length(text.text_or_empty(F.col("text"))).cast("bigint").alias("chars"), text.first_email(F.col("text")).alias("email"))


_U = "lower(trim(coalesce(url, '')))"
_UP = lambda k: f"regexp_extract({_U}, '^(?:([a-z][a-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?', {k})"


@query(f"SELECT page_id, CASE WHEN {_UP(1)} <> '' THEN {_UP(1)} || ':' ELSE '' END || CASE WHEN {_UP(2)} <> '' THEN '//' || {_UP(2)} ELSE '' END || regexp_replace({_UP(3)}, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM (SELECT *, array_to_string(list_sort(list_filter(string_split({_UP(4)}, '&'), lambda p: contains(p, '=') AND NOT regexp_matches(p, '^({fixed.TRACKING})') AND NOT ends_with(p, '='))), '&') AS q FROM pages)")
def o4_2_canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url_key"))


@query("SELECT s_suppkey, substr(sha1(lower(s_name) || '|' || cast(s_nationkey AS varchar) || '|unknown'), 1, 16) AS fingerprint FROM supplier")
def o4_1_fingerprint(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", text.fingerprint(F.lower("s_name"), F.col("s_nationkey").cast("string"), F.lit("")).alias("fingerprint"))


# -- parsing ----------------------------------------------------------------------------

PAY = ["Tk. 20,000 - 25,000 (Monthly)", "Salary: Tk 18k", "Tk. 1.2 lakh", "Negotiable", "Tk 30,000 to Tk 20,000", "25000 taka", "", "as per company policy", "BDT 45 thousand - 60 thousand", "none here"]
PAY_ANSWER = [(20000, 25000, "Tk 20,000 - 25,000"), (18000, None, "Tk 18,000"), (120000, None, "Tk 120,000"), (None, None, "Negotiable"), (20000, 30000, "Tk 20,000 - 30,000"), (25000, None, "Tk 25,000"), (None, None, ""), (None, None, "Negotiable"), (45000, 60000, "Tk 45,000 - 60,000"), (None, None, "")]


@case(f"SELECT t, lo::int AS lo, hi::int AS hi, label FROM (VALUES {sql_values([(t, *a) for t, a in zip(PAY, PAY_ANSWER, strict=True)])}) v(t, lo, hi, label)")
def o8_8_parse_salary(spark, sf_dir):
    """O8.7, O8.8 against stated answers."""
    p = literal(spark, [(t,) for t in PAY], "t string").withColumn("p", parse.parse_salary(F.col("t")))
    return p.select("t", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), F.col("p.text").alias("label"))


@query("SELECT p_partkey, CASE WHEN v < 1000 THEN round_even(v * 1000, 0)::int ELSE round_even(v, 0)::int END AS amount FROM (SELECT p_partkey, p_retailprice AS v FROM part)")
def o8_7_amount(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", parse.amount(F.format_string("%s", F.col("p_retailprice").cast("string")), F.lit("")).alias("amount"))


DATES = [("25 Sep 2026", "2026-09-25"), ("September 5, 2026", "2026-09-05"), ("2026-01-31", "2026-01-31"), ("31/12/2025", "2025-12-31"), ("Deadline: 3 Oct 2026", "2026-10-03"), ("2 days ago", "2026-10-08"), ("1 week ago", "2026-10-03"), ("5 hours ago", "2026-10-10"), ("today", "2026-10-10"), ("junk", None), ("apply by 7-Nov-2026 please", "2026-11-07"), ("Mon, 05 Oct 2026 10:00:00 +0000", "2026-10-05"), ("2026-09-01T10:00:00Z", "2026-09-01")]


@case(f"SELECT t, d::date AS d FROM (VALUES {sql_values(DATES)}) v(t, d)")
def o8_10_parse_date(spark, sf_dir):
    return literal(spark, [(t,) for t, _ in DATES], "t string").select("t", parse.parse_date(F.col("t"), F.lit("2026-10-10").cast("date")).alias("d"))


@query(f"SELECT n1.n_nationkey AS a, n2.n_nationkey AS b, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(n2.n_nationkey * 3.0) - radians(n1.n_nationkey * 3.0)) / 2), 2) + cos(radians(n1.n_nationkey * 3.0)) * cos(radians(n2.n_nationkey * 3.0)) * pow(sin(radians(n2.n_nationkey * 5.0 - n1.n_nationkey * 5.0) / 2), 2))), 1) AS km FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey")
def o8_11_haversine(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", parse.haversine_km(F.col("a") * 3.0, F.col("a") * 5.0, F.col("b") * 3.0, F.col("b") * 5.0).alias("km"))


PLACES = [("Gulshan 1, Dhaka", "Gulshan 1", False), ("Dhaka", "Dhaka (area not stated)", False), ("Remote", "Remote", True), ("Mirpur DOHS", "Mirpur Dohs", False), ("Paris", "", False), ("Sher-e-Bangla Nagar", "Sher E Bangla Nagar", False)]


@case(f"SELECT loc, area, remote FROM (VALUES {sql_values(PLACES)}) v(loc, area, remote)")
def o8_12_resolve_area(spark, sf_dir):
    """O8.12, O4.20."""
    p = literal(spark, [(x,) for x, *_ in PLACES], "loc string").withColumn("p", parse.resolve_area(F.col("loc"), F.lit("")))
    return p.select("loc", F.col("p.area").alias("area"), F.col("p.remote").alias("remote"))


ABROAD = [("London, UK", "UK"), ("Singapore", "Singapore"), ("Dhaka, Bangladesh", None), ("Berlin, Germany", "Germany"), ("Romania", "Romania"), ("", None), ("Dubai, UAE / Dhaka", None)]


@case(f"SELECT loc, country FROM (VALUES {sql_values(ABROAD)}) v(loc, country)")
def o3_9_foreign_country(spark, sf_dir):
    return literal(spark, [(x,) for x, _ in ABROAD], "loc string").select("loc", parse.foreign_country(F.col("loc")).alias("country"))


KINDS = [("SQA Engineer", "", "Software Quality Assurance"), ("Management Trainee Officer", "", "Management & Business"), ("Commission Agent", "mission driven", "Information Technology"), ("MIS Officer", "", "MIS"), ("PHP Developer", "laravel", "Software Development"), ("IT Support", "network server", "Information Technology")]


@case(f"SELECT title, body, category FROM (VALUES {sql_values(KINDS)}) v(title, body, category)")
def o8_9_category(spark, sf_dir):
    """O8.9, O5.7."""
    return literal(spark, [(a, b) for a, b, _ in KINDS], "title string, body string").select("title", "body", parse.infer_category(F.col("title"), F.col("body")).alias("category"))


RELEVANT = [("SQA Engineer", True), ("Software Quality Assurance Lead", True), ("Management Consultant", False), ("Data Operations Analyst", True), ("Driver", False)]


@case(f"SELECT title, ok FROM (VALUES {sql_values(RELEVANT)}) v(title, ok)")
def o3_2_relevance(spark, sf_dir):
    """O3.2, O7.8."""
    return literal(spark, [(t,) for t, _ in RELEVANT], "title string").select("title", parse.is_relevant(F.col("title"), ["software quality assurance", "junior data analyst", "management trainee"]).alias("ok"))


# -- scoring: parts as postings ----------------------------------------------------------

PROFILE = scoring.Profile(titles=["green steel", "qa blue copper"], skills=["tin", "steel", "Red"], categories=["ECONOMY BRASS"], minimum=20, strong=45, years=2, excluded=["black"])


def part_postings(spark, sf_dir):
    """title = p_name, company = p_brand, category = p_type, years = p_size, pay = p_retailprice."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.lit("").alias("description"), F.col("p_type").alias("category"),
        F.concat(F.col("p_size") % 8, F.lit(" years")).alias("experienceText"), F.lit("").alias("requiredSkills"), F.lit("Dhaka").alias("location"), F.lit("Tejgaon").alias("area"),
        F.bround(F.col("p_retailprice") * 20).cast("int").alias("salaryMin"), F.lit(None).cast("int").alias("salaryMax"), (F.col("p_size") / 2.0).alias("distanceKm"), F.sha1(F.col("p_partkey").cast("string")).alias("fingerprint"),
    )


def _title_fit_sql() -> str:
    out = []
    for t in PROFILE.titles:
        w = list(dict.fromkeys(scoring.plain_words(t, fixed.SCORE_ABBREVIATIONS)))
        out.append("(200 * (" + " + ".join(f"list_contains(w, '{x}')::int" for x in w) + f") + {len(w)}) // {2 * len(w)}")
    return "greatest(0, " + ", ".join(out) + ")"


_SCORED = f"""
SELECT p_partkey AS seq, tf AS "titleFit", lf AS "levelFit", sf AS "skillFit", pf AS "prefFit", ((40 * tf + 25 * lf + 25 * sf + 10 * pf + 50) // 100)::int AS "matchScore", p_name, p_retailprice, p_size FROM (
SELECT *, {_title_fit_sql()}::int AS tf,
 CASE WHEN regexp_matches(lower(p_name), '\\b({fixed.SENIOR_TITLE})\\b') THEN 10 WHEN regexp_matches(lower(p_name), '\\b({fixed.JUNIOR_TITLE})\\b') THEN 100
  WHEN p_size % 8 - 2 <= 0 THEN 100 WHEN p_size % 8 - 2 = 1 THEN 80 WHEN p_size % 8 - 2 = 2 THEN 55 WHEN p_size % 8 - 2 = 3 THEN 30 ELSE 10 END AS lf,
 least(100, (100 * ({' + '.join(f"list_contains(w, '{k}')::int" for _, k in scoring.skill_phrases(PROFILE))}) + 3) // 6)::int AS sf,
 CASE WHEN lower(p_type) = 'economy brass' THEN 100 ELSE 40 END AS pf
FROM (SELECT *, {WORDS.format('p_name')} AS w FROM part))"""


@query(f'SELECT seq, "titleFit", "levelFit", "skillFit", "prefFit", "matchScore" FROM ({_SCORED})')
def o9_s6_score(spark, sf_dir):
    """O9.S1 to O9.S6."""
    return scoring.analyse(part_postings(spark, sf_dir), PROFILE).select("seq", "titleFit", "levelFit", "skillFit", "prefFit", "matchScore")


_GATED = f"""SELECT seq, "matchScore", CASE WHEN hard THEN 'C' WHEN "matchScore" >= 45 THEN 'A' WHEN "matchScore" >= 20 THEN 'B' ELSE 'C' END AS priority, n AS n_notes FROM (
SELECT *, (pay < 25000)::int + (p_size / 2.0 > 10)::int + bad::int AS n, (p_size / 2.0 > 20 OR bad) AS hard FROM (
SELECT *, round_even(p_retailprice * 20, 0)::int AS pay, list_contains(regexp_extract_all(lower(p_name), '[a-z0-9+#]+'), 'black') AS bad FROM ({_SCORED})))"""


def scored_parts(spark, sf_dir):
    return scoring.score_postings(part_postings(spark, sf_dir), PROFILE, min_salary=25000, max_km=10)


@query(_GATED)
def o9_s8_gates(spark, sf_dir):
    """O9.S8 to O9.S10, O3.8."""
    return scored_parts(spark, sf_dir).select("seq", "matchScore", "priority", F.size("gateNotes").alias("n_notes"))


@query(f'SELECT count(*) AS total, count(*) FILTER (priority = \'A\') AS "A", count(*) FILTER (priority = \'B\') AS "B", count(*) FILTER (priority = \'C\') AS "C" FROM ({_GATED})')
def o5_1_priority_counts(spark, sf_dir):
    """O5.1, O5.2."""
    return state.run_counts(scored_parts(spark, sf_dir))


@query(f'SELECT seq, priority, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY "matchScore" DESC, seq) AS rank FROM ({_GATED})) WHERE rank <= 5')
def o5_3_top_rows(spark, sf_dir):
    """O5.3, O6.6: the first five of each priority."""
    return state.top_rows(scored_parts(spark, sf_dir), 5, tie="seq").select("seq", "priority", "rank")


# -- state: orders as postings -----------------------------------------------------------


def order_feeds(spark, sf_dir):
    """fresh = orders since 1997, previous = before; ledger = customers' earlier orders."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Applied").when(F.col("o_orderstatus") == "O", "Awaiting Review").otherwise("Rejected")
    p = o.select(F.col("o_custkey").cast("string").alias("fingerprint"), F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("createdAt"), F.lit(None).cast("string").alias("deadline"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"))
    newest = F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.desc("at"), F.desc("k")))
    pick = lambda c: p.where(c).withColumn("n", newest).where("n = 1").drop("n", "k", "at")
    fresh, previous = pick(F.col("at") >= "1997-01-01"), pick(F.col("at") < "1997-01-01")
    ledger = previous.select("fingerprint", F.col("createdAt").alias("first_seen"), "status", F.lit(False).alias("notified"), F.col("createdAt").alias("last_seen"))
    return fresh, previous, ledger


_ORD = """WITH p AS (SELECT o_custkey::varchar AS fingerprint, o_orderkey::varchar AS id, CASE o_orderstatus WHEN 'F' THEN 'Applied' WHEN 'O' THEN 'Awaiting Review' ELSE 'Rejected' END AS status, o_orderdate::date::varchar AS created, o_orderkey AS k, o_orderdate AS ts FROM orders),
fresh AS (SELECT * FROM p WHERE ts >= '1997-01-01' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, k DESC) = 1),
prev AS (SELECT * FROM p WHERE ts < '1997-01-01' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, k DESC) = 1)"""


@query(_ORD + """, kept AS (
SELECT f.fingerprint, coalesce(v.id, f.id) AS id, CASE WHEN v.fingerprint IS NULL THEN f.status WHEN v.status <> 'Awaiting Review' THEN v.status ELSE v.status END AS status, coalesce(v.created, f.created) AS "createdAt", v.fingerprint IS NULL AS is_new FROM fresh f LEFT JOIN prev v USING (fingerprint)
UNION ALL SELECT v.fingerprint, v.id, v.status, v.created, false FROM prev v WHERE v.status = 'Applied' AND v.fingerprint NOT IN (SELECT fingerprint FROM fresh))
SELECT * FROM kept WHERE status = 'Applied' OR "createdAt" >= (DATE '1998-08-01' - 400)::varchar""")
def o4_11_merge_feed(spark, sf_dir):
    """O4.11, O4.12, O3.5, O10.1 to O10.4."""
    fresh, previous, ledger = order_feeds(spark, sf_dir)
    feed, _, _ = state.merge_feed(fresh, previous, ledger, F.lit("1998-08-01").cast("date"), days=400)
    return feed.select("fingerprint", "id", "status", "createdAt", "is_new")


@query(_ORD + "SELECT coalesce(v.fingerprint, f.fingerprint) AS fingerprint, coalesce(v.created, f.created) AS first_seen, coalesce(v.status, f.status) AS status, CASE WHEN f.fingerprint IS NOT NULL THEN '1998-08-01' ELSE v.created END AS last_seen FROM prev v FULL JOIN fresh f ON v.fingerprint = f.fingerprint")
def o10_4_ledger(spark, sf_dir):
    fresh, previous, ledger = order_feeds(spark, sf_dir)
    _, after, _ = state.merge_feed(fresh, previous, ledger, F.lit("1998-08-01").cast("date"))
    return after.select("fingerprint", "first_seen", "status", "last_seen")


@query(_ORD + "SELECT coalesce(v.fingerprint, f.fingerprint) AS fingerprint, coalesce(v.created, f.created) AS first_seen, coalesce(v.status, f.status) AS status, false AS notified, CASE WHEN f.fingerprint IS NOT NULL THEN '1998-08-01' ELSE v.created END AS last_seen FROM prev v FULL JOIN fresh f ON v.fingerprint = f.fingerprint")
def o10_4_ledger_merge(spark, sf_dir):
    """O2.2, O10.4: the ledger in hash buckets; a run rewrites those its postings fall into."""
    fresh, _, ledger = order_feeds(spark, sf_dir)
    t = BucketTable(spark, new_path(spark, "ledger"), "fingerprint", state.LEDGER, 16)
    t.merge(ledger)
    state.upsert_ledger(t, fresh, F.lit("1998-08-01").cast("date"))
    return t.read()


@query(_ORD + "SELECT v.fingerprint, CASE WHEN f.fingerprint IS NOT NULL THEN f.status ELSE v.status END AS status, f.fingerprint IS NOT NULL AS changed FROM prev v LEFT JOIN fresh f ON v.fingerprint = f.fingerprint")
def o4_15_decisions(spark, sf_dir):
    """O4.15: fresh orders as decisions on the ledger."""
    fresh, _, ledger = order_feeds(spark, sf_dir)
    out = state.apply_decisions(ledger, fresh.select("fingerprint", "status", F.col("createdAt").alias("decidedAt")), F.lit("1998-08-01"))
    return out.select("fingerprint", "status", F.col("decided_at").isNotNull().alias("changed"))


@query(_ORD + "SELECT f.fingerprint, coalesce(v.status, f.status) AS status, coalesce(v.id, f.id) AS id FROM fresh f LEFT JOIN prev v ON f.fingerprint = v.fingerprint UNION ALL SELECT v.fingerprint, v.status, v.id FROM prev v WHERE v.status = 'Applied' AND v.fingerprint NOT IN (SELECT fingerprint FROM fresh)")
def o4_13_client_merge(spark, sf_dir):
    """O4.13: the feed over a client's copy."""
    fresh, previous, _ = order_feeds(spark, sf_dir)
    none = fresh.where("false").select("fingerprint", "status", F.col("createdAt").alias("decidedAt"))
    return state.client_merge(fresh, previous, none).select("fingerprint", "status", "id")


@query(_ORD + "SELECT f.fingerprint, coalesce(v.status, f.status) AS status FROM fresh f LEFT JOIN prev v ON f.fingerprint = v.fingerprint UNION ALL SELECT v.fingerprint, v.status FROM prev v WHERE v.fingerprint NOT IN (SELECT fingerprint FROM fresh)")
def o4_14_review_merge(spark, sf_dir):
    """O4.14: every vanished row stays."""
    fresh, previous, _ = order_feeds(spark, sf_dir)
    none = fresh.where("false").select("fingerprint", "status", F.col("createdAt").alias("decidedAt"))
    return state.client_merge(fresh, previous, none, keep_vanished=True).select("fingerprint", "status")


def event_runs(spark, sf_dir):
    """source = user, run = day, found = purchases, errors = error events, raw = events."""
    e = read(spark, sf_dir, "events")
    g = e.groupBy(F.col("user_id").cast("string").alias("source"), F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("run"))
    return g.agg(F.count_if(F.col("event_type") == "purchase").alias("found"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count("*").alias("raw"))


@query("""WITH g AS (SELECT user_id::varchar AS source, date_diff('day', DATE '2024-01-01', ts::date) AS run, count(*) FILTER (event_type = 'purchase') AS found, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1, 2),
b AS (SELECT *, (found = 0 AND e > 0) AS bad, sum(CASE WHEN found = 0 AND e > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY run) AS island FROM g),
s AS (SELECT *, sum(bad::int) OVER (PARTITION BY source, island ORDER BY run) AS streak FROM b)
SELECT source, run, streak::bigint AS streak, bad AND streak = 2 AS alert FROM s""")
def o6_1_health(spark, sf_dir):
    """O6.1, O10.6."""
    return state.health(event_runs(spark, sf_dir), threshold=2).select("source", "run", "streak", "alert")


@query("SELECT CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS source, count(*) AS found FROM documents GROUP BY 1")
def o5_4_source_report(spark, sf_dir):
    """O5.4, O7.6: the report of two sources."""
    d = read(spark, sf_dir, "documents")
    row = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("company"), "lang")
    give = lambda which: lambda own, queries: (row.where(which).drop("lang"), None, [])
    _, report = fanin.collect(spark, {"a": True, "b": True}, {"a": give("lang = 'en'"), "b": give("NOT coalesce(lang = 'en', false)")}, [])
    return report.select(F.col("discoveredBy").alias("source"), "found")


@query(f"SELECT sha1(seq::VARCHAR) AS fingerprint, priority = 'A' AS notified FROM ({_GATED})")
def o2_5_notified_after_commit(spark, sf_dir):
    """O2.5, O10.5: notices of priority A in an outbox; the ledger marks them once they are committed."""
    feed = scored_parts(spark, sf_dir).select("fingerprint", "seq", "priority", "matchScore", "title", "company")
    ledger, new = BucketTable(spark, new_path(spark, "ledger"), "fingerprint", state.LEDGER, 16), feed.select("fingerprint")
    state.upsert_ledger(ledger, feed.select("fingerprint", F.lit("2026-01-01").alias("createdAt"), F.lit("Awaiting Review").alias("status")), F.lit("2026-01-02").cast("date"))
    notices.notify(state.notice_picks(feed, new, "A", force=True), new_path(spark, "outbox"), 1, ledger)
    return ledger.read().select("fingerprint", "notified")


@query("""WITH p AS (SELECT o_orderkey::VARCHAR AS fingerprint, CASE o_orderstatus WHEN 'F' THEN 'Applied' WHEN 'O' THEN 'Awaiting Review' ELSE 'Rejected' END AS status, o_orderdate::date AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::date + 30 END AS deadline, (SELECT max(o_orderdate)::date FROM orders) AS today FROM orders)
SELECT fingerprint, status FROM p WHERE status = 'Applied' OR (coalesce(deadline >= today, true) AND d >= today - 400)""")
def o10_2_retention_stream(spark, sf_dir):
    """O10.2, O3.5: orders as a stream of postings; what the timers have left at its end."""
    orders = read(spark, sf_dir, "orders")
    buckets = max(16, orders.count() // retention.PER_BUCKET)
    o = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    status = F.when(F.col("o_orderstatus") == "F", "Applied").when(F.col("o_orderstatus") == "O", "Awaiting Review").otherwise("Rejected")
    day = F.col("o_orderdate").cast("date")
    p = o.select(F.col("o_orderkey").cast("string").alias("fingerprint"), F.col("o_orderdate").cast("timestamp").alias("at"), day.cast("string").alias("createdAt"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 30)).alias("deadline"), status.alias("status"))
    out = new_path(spark, "retention")
    with retention.timed_state(spark):
        q = retention.retention_stream(p, days=400, buckets=buckets).writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    changes = spark.read.schema(retention.CHANGES).parquet(f"{out}/changes")
    return changes.groupBy("fingerprint").agg(F.max("status").alias("status"), F.bool_or(F.col("change") == "expired").alias("gone")).where("not gone").drop("gone")


# -- versions: conversations and orders ----------------------------------------------------


@query("SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS b, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n = 1 OR b IS DISTINCT FROM role")
def o6_3_changed_versions(spark, sf_dir):
    return versions.changed_versions(read(spark, sf_dir, "conversations"), "conv_id", "turn", ["role"]).select("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN n > 1 THEN (CASE WHEN r IS DISTINCT FROM role THEN 'Role ' ELSE '' END) || (CASE WHEN t IS DISTINCT FROM text THEN 'Text' ELSE '' END) END AS changed FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS t, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def o6_4_diff_versions(spark, sf_dir):
    d = versions.diff_versions(read(spark, sf_dir, "conversations"), "conv_id", "turn", {"role": "Role ", "text": "Text"})
    return d.select("conv_id", "turn", F.array_join("changed", "").alias("changed"))


@query("SELECT o_custkey, o_orderkey, o_orderdate::date AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def o6_7_latest(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return versions.latest(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT o_custkey::varchar AS id, o_orderdate::date::varchar AS \"updatedAt\", o_orderstatus AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, (o_orderkey % 2), o_orderkey DESC) = 1")
def o4_17_merge_versions(spark, sf_dir):
    """O4.17, O7.10: even orders are the current side, odd ones the other."""
    o = read(spark, sf_dir, "orders").withColumns({"id": F.col("o_custkey").cast("string"), "updatedAt": F.col("o_orderdate").cast("date").cast("string"), "v": F.col("o_orderstatus")})
    one = lambda k: versions.latest(o.where(F.col("o_orderkey") % 2 == k), "id", [F.desc("updatedAt"), F.desc("o_orderkey")])
    return versions.merge_versions(one(0), one(1)).select("id", "updatedAt", "v")


@query("SELECT coalesce(a.c_custkey, b.o_custkey) AS id, coalesce(a.c_mktsegment, b.f1) AS f1, coalesce(NULL, b.f2) AS f2 FROM customer a FULL JOIN (SELECT o_custkey, min(o_orderpriority) AS f1, max(o_orderstatus) AS f2 FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey")
def o4_18_merge_private(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("f1"), F.lit(None).cast("string").alias("f2"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("f1"), F.max("o_orderstatus").alias("f2"))
    return versions.merge_private(c, o, "id", ["f1", "f2"])


# -- deduplication: documents as postings --------------------------------------------------


def document_postings(spark, sf_dir):
    """company = language and source, title = the first line, body = text."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"), F.substring_index("text", "\n", 1).alias("title"), F.concat_ws(" ", "lang", "source").alias("company"), F.col("text").alias("description"),
        F.concat(F.lit("https://x.example/"), F.md5("text")).alias("url"), F.lit("").alias("area"), F.col("source"), F.lit("").alias("requiredSkills"), F.lit(None).cast("int").alias("salaryMin"), F.lit(None).cast("int").alias("salaryMax"),
        F.lit("").alias("salaryText"), F.lit(None).cast("string").alias("deadline"), F.lit("").alias("employmentType"), F.lit("").alias("experienceText"), F.lit(None).cast("double").alias("distanceKm"), F.lit(None).cast("string").alias("postedAt"),
    )


_SHINGLES = f"""w AS (SELECT doc_id, list_filter(string_split({SLUG.format('text')}, ' '), lambda x: length(x) > 2) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, ('0x' || substr(md5(array_to_string(w[i:i+2], ' ')), 17, 16))::UBIGINT AS h FROM s),
b AS (SELECT doc_id, k, sum(CASE WHEN (h >> k) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT unnest(range(64)) AS k) GROUP BY ALL),
f AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << k) ELSE 0 END) AS f FROM b GROUP BY 1)"""


@query(f"WITH {_SHINGLES} SELECT documents.doc_id, lower(printf('%016x', coalesce(f.f, 0)::UBIGINT)) AS sim FROM documents LEFT JOIN f USING (doc_id)")
def o4_4_simhash(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.lower(F.lpad(F.hex(dedupe.simhash(F.col("text"))), 16, "0")).alias("sim"))


def _groups_sql() -> str:
    first = "split_part(coalesce(text, ''), chr(10), 1)"
    title = COLLAPSE.replace("{0}", f"regexp_replace({title_sql(first)}, '\\b({fixed.SENIORITY})\\b', ' ', 'g')")
    return f"""WITH RECURSIVE {_SHINGLES},
p AS (SELECT d.doc_id AS seq, {company_sql("concat_ws(' ', lang, source)")} AS c, {title} AS t, md5(text) AS u, coalesce(f.f, 0)::UBIGINT AS sim, source, length(coalesce(text, '')) AS size FROM documents d LEFT JOIN f USING (doc_id)),
k AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) > 2)) AS tok FROM p),
e AS (SELECT a.seq AS a, b.seq AS b FROM k a JOIN k b ON a.seq <> b.seq AND a.c = b.c AND a.t = b.t
 UNION SELECT a.seq, b.seq FROM k a JOIN k b ON a.seq <> b.seq AND a.u = b.u
 UNION SELECT a.seq, b.seq FROM k a JOIN k b ON a.seq <> b.seq AND a.c = b.c AND len(list_intersect(a.tok, b.tok)) > 0
  AND (len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok))) >= {fixed.TITLE_JACCARD} OR (a.sim <> 0 AND b.sim <> 0 AND bit_count(xor(a.sim, b.sim)) <= {fixed.SIMHASH_DISTANCE}))),
r AS (SELECT seq AS a, seq AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS seq, min(b) AS group_id FROM r GROUP BY a),
m AS (SELECT g.group_id, k.* FROM k JOIN g USING (seq))"""


_MERGED = """ SELECT group_id, arg_max(seq, (size, -seq)) AS seq, count(*) AS n_merged, array_to_string(list_sort(list_distinct(list(coalesce(nullif(source, ''), 'unknown')))), ' + ') AS source, count(DISTINCT (coalesce(nullif(source, ''), 'unknown'), u))::INT AS n_sources FROM m GROUP BY group_id"""


@query(_groups_sql() + _MERGED)
def o4_5_dedupe_groups(spark, sf_dir):
    """O4.5 to O4.10 on documents."""
    return dedupe.deduplicate(document_postings(spark, sf_dir)).select("group_id", "seq", "n_merged", "source", F.size("sources").alias("n_sources"))


@query(_groups_sql() + " SELECT seq, group_id AS entity FROM g")
def o4_5_day_by_day(spark, sf_dir):
    """O4.5, O10.1: documents taken into an entity store on two days make the groups of one run."""
    p, store = document_postings(spark, sf_dir), resolution.EntityStore(spark, new_path(spark, "entities"), 8)
    for day in (0, 1):
        store.add(p.where(F.col("seq") % 2 == day))
    return store.members()


_TOKENS = f"list_sort(list_distinct(list_filter(string_split({SLUG.format("split_part(coalesce(text, ''), chr(10), 1)")}, ' '), lambda x: length(x) > 2)))"


@query(f"WITH k AS (SELECT source, {_TOKENS} AS t, min(doc_id) AS seq FROM documents GROUP BY 1, 2) SELECT a.seq AS a, b.seq AS b, round(len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t))), 6) AS j FROM k a JOIN k b ON a.source = b.source AND a.seq < b.seq WHERE len(list_intersect(a.t, b.t)) > 0 AND len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t))) >= {fixed.TITLE_JACCARD}")
def o4_6_close_titles(spark, sf_dir):
    """O4.3, O4.6: close first lines of one source; lines alike by their first document."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("norm_company"), text.slug_tokens(F.substring_index("text", "\n", 1)).alias("title_tokens"))
    return dedupe.title_edges(dedupe.title_nodes(d)).select("a", "b", F.round("jaccard", 6).alias("j"))


_PART_TITLES = f"""WITH RECURSIVE k AS (SELECT p_brand AS c, list_sort(list_distinct(list_filter(string_split({SLUG.format("p_name || ' ' || p_type || ' ' || CASE WHEN p_size > 25 THEN 'large' ELSE 'fine' END")}, ' '), lambda x: length(x) > 2))) AS t, min(p_partkey) AS seq, count(*) AS n FROM part GROUP BY ALL),
e AS (SELECT a.seq AS a, b.seq AS b FROM k a JOIN k b ON a.c = b.c AND a.seq <> b.seq WHERE len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t))) >= 0.5),
r AS (SELECT seq AS a, seq AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS seq, min(b) AS group_id FROM r GROUP BY a)"""


@query(_PART_TITLES + " SELECT group_id, count(*) AS titles, sum(n)::BIGINT AS postings FROM g JOIN k USING (seq) GROUP BY 1")
def o4_6_title_groups(spark, sf_dir):
    """O4.6: parts of a brand grouped by close titles (half of the tokens), without all pairs."""
    size = F.when(F.col("p_size") > 25, "large").otherwise("fine")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("norm_company"), text.slug_tokens(F.concat_ws(" ", "p_name", "p_type", size)).alias("title_tokens"))
    titles = dedupe.title_nodes(p)
    group = components(dedupe.title_links(titles, 0.5), "titles").withColumnsRenamed({"node": "seq", "root": "group_id"})
    many = p.groupBy("norm_company", F.array_sort("title_tokens").alias("tokens")).agg(F.count("*").alias("n"))
    each = titles.join(group, "seq", "left").join(many, ["norm_company", "tokens"])
    return each.groupBy(F.coalesce("group_id", "seq").alias("group_id")).agg(F.count("*").alias("titles"), F.sum("n").alias("postings"))


# -- keywords: documents with a lexicon of corpus words -------------------------------------

_LEX = {w: ("tech", "Words", None, [w]) for w in ("the", "and", "with", "les", "und", "los")}


@query("""SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), (VALUES ('the'), ('and'), ('with'), ('les'), ('und'), ('los')) k(key)
WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9+#])' || key || '(s|es)?($|[^A-Za-z0-9+#])') GROUP BY 1, 2""")
def o9_4_lexicon_hits(spark, sf_dir):
    """O9.2 to O9.4 on lines."""
    d = read(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split(text.text_or_empty(F.col("text")), "\n")).alias("seg", "segment"))
    return keywords.hits(lines, keywords.lexicon_table(spark, _LEX)).groupBy("doc_id", "key").agg(F.count("*").alias("n"))


POST = "Key Responsibilities\nDesign test cases and run Docker\nRequirements\n3+ years of Python experience\nDocker is a plus\nSkills: SQL, Excel\nBSc in CSE\nAbout Us\nWe use Kubernetes"


@case("SELECT * FROM (VALUES ('python', 'must', 3), ('test case', 'important', NULL), ('docker', 'important', NULL), ('sql', 'must', NULL), ('excel', 'must', NULL), ('bachelor''s degree', 'must', NULL)) v(key, tier, years)")
def o9_13_extract(spark, sf_dir):
    """O9.5 to O9.10, O6.5, O5.8 on a post whose answer is stated."""
    d = literal(spark, [(1, "Engineer", POST)], "doc_id bigint, title string, text string")
    return keywords.extract(d, keywords.lexicon_table(spark)).select("key", "tier", F.col("yearsRequired").alias("years"))


@query("SELECT p_partkey, CASE WHEN p_size * 1000 < 20000 THEN 'below' ELSE 'inside' END AS state, CASE WHEN p_size * 1000 < 20000 THEN 20000 ELSE least(greatest(20000, p_size * 500), p_size * 1000) END AS amount FROM part")
def o9_28_suggest_salary(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("s", keywords.suggest_salary(F.col("p_size") * 500, F.col("p_size") * 1000, F.lit(20000)))
    return p.select("p_partkey", F.col("s.state").alias("state"), F.col("s.amount").alias("amount"))


# -- sources ------------------------------------------------------------------------------


@query("SELECT page_id, len(regexp_extract_all(html, '<a\\b[^>]*?href=[\"'']([^\"'']+)[\"''][^>]*>')) AS n_links FROM pages")
def o1_24_anchors(spark, sf_dir):
    """O1.24, O1.22: anchors of pages."""
    p = read(spark, sf_dir, "pages")
    a = landed.anchors(p.select(F.col("page_id").cast("string").alias("url"), "html")).groupBy("url").agg(F.count("*").alias("n_links"))
    return p.select("page_id").join(a, F.col("page_id").cast("string") == F.col("url"), "left").select("page_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


LD = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"QA Engineer","hiringOrganization":{"name":"Acme Ltd"},"datePosted":"2026-10-01","jobLocation":{"address":{"addressLocality":"Banani","addressRegion":"Dhaka"}},"employmentType":"FULL_TIME","baseSalary":{"currency":"BDT","value":{"minValue":600000,"unitText":"YEAR"}},"description":"x"}]}</script>'


@case("SELECT 'QA Engineer' AS title, 'Acme Ltd' AS company, 'Banani, Dhaka' AS location, 'Full time' AS \"employmentType\", 50000 AS \"salaryMin\", DATE '2026-10-01' AS \"postedAt\", 'https://a.example/1' AS url")
def o1_10_jsonld(spark, sf_dir):
    """O1.10 to O1.17."""
    pages = literal(spark, [("https://a.example/1", LD)], "url string, body string")
    return landed.jsonld(pages, F.lit("2026-10-10").cast("date")).select("title", "company", "location", "employmentType", "salaryMin", "postedAt", "url")


FEED = "<rss><item><title>Acme: Backend Developer</title><link>https://b.example/7</link><region>Asia</region><description>&lt;p&gt;Tk 40,000&lt;/p&gt;</description></item><item><title>Other: Cook</title><link>https://b.example/8</link><region>Mars</region></item></rss>"


@case("SELECT 'Backend Developer' AS title, 'Acme' AS company, 'Asia' AS location, 40000 AS \"salaryMin\", 'https://b.example/7' AS url")
def o1_8_rss(spark, sf_dir):
    """O1.8, O1.9, O3.3."""
    p = literal(spark, [("f", FEED)], "url string, body string")
    return landed.rss(p, F.lit("2026-10-10").cast("date"), regions=["asia"], title_format="company: role").select("title", "company", "location", "salaryMin", "url")


@query(f'SELECT seq, \'| \' || priority || \' | \' || "matchScore" || \' |\' AS line FROM ({_GATED})')
def o2_6_markdown(spark, sf_dir):
    """O2.6: table rows of a notice."""
    return scored_parts(spark, sf_dir).select("seq", sinks.markdown_row(["priority", "matchScore"]).alias("line"))


@query(f'SELECT seq, p_name || \' - \' || p_brand || \' (Tejgaon, pay not stated) [\' || "matchScore" || \'%]\' AS line FROM ({_SCORED}) s JOIN (SELECT p_partkey, p_brand FROM part) b ON s.seq = b.p_partkey')
def o2_8_summary_line(spark, sf_dir):
    return scored_parts(spark, sf_dir).withColumn("salaryText", F.lit("")).select("seq", state.summary_line().alias("line"))


def _all() -> None:
    from . import composed, scale, stated, tables  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def cases() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    _all()
    return dict(CASES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
