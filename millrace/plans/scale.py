"""Queries of operators that work by an index, a grid or a layout, and of the library from SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..functions import fixed
from ..functions.text import text_or_empty
from ..operators import keywords, phrases, places, search, state
from ..operators.graph import new_path
from ..sources import pages
from .catalogue import _GATED, SLUG, query, read, scored_parts

# -- phrases: pairs of words of the benchmark as wordings, documents as texts ---------------

_EDGE = keywords.EDGE


@query(f"""WITH lex AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+ [a-z]+')) AS alias FROM benchmark),
l AS (SELECT doc_id, seg, trim(regexp_replace(replace(line, chr(13), ' '), '[\\s\\-_]+', ' ', 'g')) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS seg FROM documents)),
w AS (SELECT doc_id, seg, n, regexp_extract_all(lower(n), '[a-z0-9+#]+') AS w FROM l),
g AS (SELECT DISTINCT doc_id, seg, n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
f AS (SELECT doc_id, seg, n, unnest([g, CASE WHEN ends_with(g, 's') THEN left(g, -1) END, CASE WHEN ends_with(g, 'es') THEN left(g, -2) END]) AS g FROM g),
h AS (SELECT DISTINCT doc_id, seg, alias FROM f JOIN lex ON alias = g WHERE regexp_matches(n, '(?i)(^|[^A-Za-z0-9+#])' || alias || '(s|es)?($|[^A-Za-z0-9+#])'))
SELECT doc_id, count(*) AS n FROM h GROUP BY 1""")
def o9_4_large_lexicon(spark, sf_dir):
    """O9.4, O4.21: every pair of plain words in the benchmark as an entry, matched on all lines of documents."""
    pairs = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(text_or_empty(F.col("text")), F.lit("[a-z]+ [a-z]+"), F.lit(0))).alias("alias")).distinct()
    pattern = F.concat(F.lit(f"(?<!{_EDGE})(?i:"), "alias", F.lit(f"(?:s|es)?)(?!{_EDGE})"))
    lexicon = pairs.select(F.col("alias").alias("key"), "alias", F.lit(0).alias("rank"), pattern.alias("pattern"))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text_or_empty(F.col("text")), "\n")).alias("seg", "segment"))
    return phrases.hits(lines, lexicon).groupBy("doc_id").agg(F.count("*").alias("n"))


_NAMES = f"SELECT DISTINCT {SLUG.format('n')} AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}(?: [a-z]{{3,}})?')) AS n FROM benchmark)"


@query(f"""WITH p AS ({_NAMES}), d AS (SELECT doc_id, ' ' || {SLUG.format("split_part(coalesce(text, ''), chr(10), 1)")} || ' ' AS l, ' ' || {SLUG.format("coalesce(text, '')")} || ' ' AS t FROM documents),
a AS (SELECT doc_id, arg_min(name, (-length(name), name)) AS name FROM d JOIN p ON contains(l, ' ' || name || ' ') GROUP BY 1),
b AS (SELECT doc_id, arg_min(name, (-length(name), name)) AS name FROM d JOIN p ON contains(t, ' ' || name || ' ') WHERE doc_id NOT IN (SELECT doc_id FROM a) GROUP BY 1)
SELECT d.doc_id, lower(coalesce(a.name, b.name, '')) AS area FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def o4_20_gazetteer(spark, sf_dir):
    """O4.20, O8.12: the longest name of a table of places (capitalised words of the benchmark) in a document's
    first line, else in all of it."""
    names = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(text_or_empty(F.col("text")), F.lit("[A-Z][a-z]{3,}(?: [a-z]{3,})?"), F.lit(0))).alias("n"))
    table = names.select(phrases.slug(F.col("n")).alias("name")).distinct().select("name", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("location"), F.col("text").alias("description"))
    return phrases.resolve_places(d, "doc_id", table, fixed.HOME, "(?!)", opening=None).select("doc_id", F.lower("area").alias("area"))


# -- places: customers as postings, suppliers as homes --------------------------------------

_LAT, _LON = "({0} * 37 % 1790) / 10.0 - 89.5", "({0} * 91 % 3600) / 10.0 - 180"
_KM = f"round(2 * {fixed.EARTH_KM} * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 1)"


def _at(rows, key):
    return rows.select(key, F.expr(_LAT.format(key)).cast("double").alias("lat"), F.expr(_LON.format(key)).cast("double").alias("lon"))


@query(f"WITH a AS (SELECT s_suppkey, ({_LAT.format('s_suppkey')})::DOUBLE AS lat, ({_LON.format('s_suppkey')})::DOUBLE AS lon FROM supplier), b AS (SELECT c_custkey, ({_LAT.format('c_custkey')})::DOUBLE AS lat, ({_LON.format('c_custkey')})::DOUBLE AS lon FROM customer) SELECT s_suppkey, c_custkey, {_KM} AS km FROM a, b WHERE {_KM} <= 500")
def o8_11_within_km(spark, sf_dir):
    """O8.11: customers within 500 km of each supplier, by a grid."""
    c, s = _at(read(spark, sf_dir, "customer"), "c_custkey"), _at(read(spark, sf_dir, "supplier"), "s_suppkey")
    return places.within_km(c, s, 500, "c_custkey", "s_suppkey").select("s_suppkey", "c_custkey", "km")


# -- search and pages ------------------------------------------------------------------------

TERM = "Token = "


@query(f"SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), lower('{TERM}'))")
def o3_6_indexed_search(spark, sf_dir):
    """O3.6: documents that hold a term, by lists of trigrams."""
    d = read(spark, sf_dir, "documents")
    index = search.TextIndex(spark, new_path(spark, "trigrams"), "doc_id", "text")
    index.build(d)
    return index.search(d, TERM).select("doc_id")


PAGE, SIZE = 7, 20


@query(f'SELECT seq, place FROM (SELECT seq, row_number() OVER (ORDER BY "matchScore" DESC, seq) - 1 AS place FROM ({_GATED})) WHERE place BETWEEN {PAGE * SIZE} AND {PAGE * SIZE + SIZE - 1}')
def o7_5_page(spark, sf_dir):
    """O7.5: a page of the list by best match, from a layout in that order."""
    path = new_path(spark, "pages")
    pages.write_pages(scored_parts(spark, sf_dir).select("seq", "title", "matchScore"), state.dashboard_keys("match", "seq"), path, 100)
    return pages.page(spark, path, PAGE, SIZE).select("seq", "place")


@query(f'SELECT seq, "matchScore" FROM (SELECT seq, "matchScore", row_number() OVER (ORDER BY "matchScore" DESC, seq) AS n FROM ({_GATED}) WHERE "matchScore" < 30 OR ("matchScore" = 30 AND seq > 50)) WHERE n <= {SIZE}')
def o7_5_page_after(spark, sf_dir):
    """O7.1, O7.5: the page after a row seen last (score 30, number 50)."""
    path = new_path(spark, "pages")
    pages.write_pages(scored_parts(spark, sf_dir).select("seq", "title", "matchScore"), state.dashboard_keys("match", "seq"), path, 50)
    past = (F.col("matchScore") < 30) | ((F.col("matchScore") == 30) & (F.col("seq") > 50))
    return pages.page_after(spark, path, past, SIZE).select("seq", "matchScore")


# -- SQL text ----------------------------------------------------------------------------------


@query("SELECT page_id, len(list_filter(regexp_extract_all(html, '<a\\b[^>]*?href=[\"'']([^\"'']+)[\"''][^>]*>', 1), lambda h: starts_with(h, '/')))::BIGINT AS n_links, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages")
def o1_24_anchors_in_sql(spark, sf_dir):
    """§2.12, O1.22, O1.24: links of pages by a table function in a lateral join, hosts by a SQL function."""
    sql.register(spark)
    read(spark, sf_dir, "pages").createOrReplaceTempView("mr_pages")
    return spark.sql("SELECT page_id, count_if(href LIKE '/%') AS n_links, first(mr_host(url)) AS host FROM mr_pages LEFT JOIN LATERAL page_anchors(html) a GROUP BY page_id")


@query(f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, substr(sha1({SLUG.format('p_brand')} || '|' || {SLUG.format('p_name')} || '|unknown'), 1, 16) AS fingerprint, len(list_intersect(regexp_extract_all(lower(p_name), '[a-z0-9+#]+'), ['red', 'ring']))::DOUBLE / len(list_distinct(list_concat(regexp_extract_all(lower(p_name), '[a-z0-9+#]+'), ['red', 'ring']))) AS near FROM part")
def o8_functions_in_sql(spark, sf_dir):
    """§2.12, O8.3, O4.1, O4.3: scalar functions from SQL text."""
    sql.register(spark)
    read(spark, sf_dir, "part").createOrReplaceTempView("mr_part")
    return spark.sql("SELECT p_partkey, mr_slug(p_name) AS slug, mr_fingerprint(mr_slug(p_brand), mr_slug(p_name), '') AS fingerprint, mr_jaccard(mr_words(p_name), array('red', 'ring')) AS near FROM mr_part")


