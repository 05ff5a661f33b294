"""Queries of further operators on whole tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, parse, text
from ..operators import keywords, mining, pack, records, requirements, state
from .catalogue import _GATED, part_postings, query, read, scored_parts, sql_list


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- lines, runs and mined terms --------------------------------------------------------------

_SEGMENTS = r"""seg AS (SELECT doc_id, unnest(s) AS segment, generate_subscripts(s, 1) - 1 AS seg FROM (SELECT doc_id, list_filter(list_transform(flatten(list_transform(list_filter(list_transform(
 flatten(list_transform(string_split(replace(replace(replace(coalesce(text, ''), chr(13), ''), '‘', ''''), '’', ''''), chr(10)), lambda x: regexp_split_to_array(x, '[ \t\f\v\r]*[•▪◦●·][ \t\f\v\r]*'))),
 lambda p: trim(regexp_replace(p, '^[\s*\-–—]+', ''))), lambda p: p <> ''),
 lambda p: CASE WHEN length(p) > 180 THEN string_split(regexp_replace(p, '([.!?;])\s+([A-Z0-9(])', '\1' || chr(10) || '\2', 'g'), chr(10)) ELSE [p] END)), lambda p: trim(p)), lambda p: p <> '') AS s FROM documents))"""


@query(f"WITH {_SEGMENTS} SELECT doc_id, count(*) AS n_lines, sum(length(segment))::BIGINT AS chars FROM seg GROUP BY doc_id")
def o9_5_lines(spark, sf_dir):
    """O9.5: lines and bullets of documents, long ones cut at sentence ends."""
    s = keywords.segments(read(spark, sf_dir, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("segment")).cast("bigint").alias("chars"))


_NOTED = rf"""{_SEGMENTS},
tier AS (SELECT *, CASE WHEN regexp_matches(segment, {quoted(fixed.CUE_NICE)}) THEN 'nice' WHEN regexp_matches(segment, {quoted(fixed.CUE_MUST)}) THEN 'must' ELSE 'important' END AS tier FROM seg),
ln AS (SELECT *, CASE tier WHEN 'must' THEN 3 ELSE 1 END AS weight, regexp_matches(segment, {quoted(fixed.LEAD_IN)}) AS lead_in, len(regexp_split_to_array(segment, '\s+')) <= 4 AND NOT regexp_matches(segment, {quoted(fixed.SENTENCE_START)}) AS short,
 trim(regexp_replace(regexp_replace(segment, '\s*/\s*', '/', 'g'), '[\s\-‐-―_]+', ' ', 'g')) AS n FROM tier),
mk AS (SELECT *, array_to_string(list_transform(flatten(list_transform(regexp_split_to_array(n, {quoted(fixed.PHRASE_BREAK)}), lambda p: list_append(list_filter(list_transform(regexp_split_to_array(p, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^A-Za-z0-9+#]+|[^A-Za-z0-9+#]+$', '', 'g'), '(?i)''s$', '')), lambda w: w <> ''), '|'))),
 lambda w: CASE WHEN length(w) < 2 OR list_contains({sql_list(mining.STOP)}, lower(w)) OR (regexp_matches(w, '^[0-9]') AND NOT regexp_matches(w, '^[0-9]+[A-Za-z]{{1,3}}$')) THEN '|' ELSE w END), ' ') AS marked FROM ln),
rs AS (SELECT * EXCLUDE (r), unnest(r) AS run, generate_subscripts(r, 1) AS pos FROM (SELECT *, list_filter(list_transform(string_split(marked, '|'), lambda r: trim(r)), lambda r: r <> '') AS r FROM mk)),
w AS (SELECT *, string_split(run, ' ') AS ws, len(string_split(run, ' ')) AS words FROM rs),
sh AS (SELECT *, regexp_replace(regexp_replace(lower(run), 'ies$', 'y'), '([^s])s$', '\1') AS key, seg::BIGINT * 16777216 + pos AS loc,
 CASE WHEN words = 1 THEN (regexp_matches(run, '^[A-Z][A-Z0-9&+]{{1,6}}$') AND NOT list_contains({sql_list(fixed.PLAIN_ACRONYMS)}, run)) OR regexp_matches(run, '^[a-z]+[A-Z]|^[A-Z][a-z]+[A-Z]') ELSE len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[A-Z0-9]'))) = 0 END AS shape,
 array_to_string(list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '^[A-Z0-9&+]+$') OR length(x) < 3 THEN x ELSE upper(substr(x, 1, 1)) || substr(x, 2) END), ' ') AS shown FROM w
 WHERE words <= {mining.MOST_WORDS} AND len(list_intersect(list_transform(ws, lambda x: lower(x)), {sql_list(fixed.PLACE_WORDS)})) = 0),
nt AS (SELECT * FROM sh WHERE words > 1 OR shape OR (length(run) >= 6 AND regexp_matches(run, {quoted(fixed.NOUN_ENDING)}))),
sp AS (SELECT doc_id, key, shown, count(*) AS n, min(loc) AS loc FROM nt GROUP BY ALL),
ac AS (SELECT doc_id, key, count(*) AS count, min(loc) AS loc, list_sum(list_sort(list(weight), 'DESC')[1:3])::BIGINT + (max(words) >= 2)::INT + bool_or(shape)::INT AS score, bool_or(shape) AS shape, max(words) AS words, min(CASE tier WHEN 'must' THEN 0 WHEN 'important' THEN 1 ELSE 2 END) AS r, bool_or(lead_in) OR bool_or(short AND tier <> 'important') AS pointed FROM nt GROUP BY ALL),
ok AS (SELECT * FROM ac WHERE pointed OR (NOT (words = 1 AND NOT shape) AND count >= 2)),
pt AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS key, max(count) AS longer FROM (SELECT doc_id, count, string_split(key, ' ') AS w, words FROM ok WHERE words > 1), (SELECT unnest(range(1, {mining.MOST_WORDS})) AS n), (SELECT unnest(range(1, {mining.MOST_WORDS + 1})) AS i) WHERE n < words AND i + n - 1 <= words GROUP BY 1, 2),
kp AS (SELECT ok.* FROM ok LEFT JOIN pt USING (doc_id, key) WHERE longer IS NULL OR longer < count)"""


def document_lines(spark, sf_dir):
    return keywords.tiered(keywords.segments(read(spark, sf_dir, "documents")).withColumn("section", F.lit("other")))


@query(f"WITH {_NOTED} SELECT doc_id, key, count, score, words::INT AS words, shape FROM ac")
def o5_9_mined_terms(spark, sf_dir):
    """O5.9, O9.11, O9.46: terms of documents and how often and how weightily they are said."""
    found = mining.noted(mining.runs(document_lines(spark, sf_dir)), fixed.PLACE_WORDS)
    return mining.accumulate(found).select("doc_id", "key", "count", "score", "words", "shape")


@query(f"WITH {_NOTED} SELECT doc_id, key, (SELECT arg_max(shown, (n, -sp.loc)) FROM sp WHERE sp.doc_id = t.doc_id AND sp.key = t.key) AS name, count, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, loc) AS rank FROM kp) t WHERE rank <= {mining.MOST_TERMS}")
def o9_12_best_terms(spark, sf_dir):
    """O9.12, O7.4: the fourteen best terms of each document (the operator's own limit)."""
    found = mining.noted(mining.runs(document_lines(spark, sf_dir)), fixed.PLACE_WORDS)
    return mining.accepted(mining.accumulate(found)).select("doc_id", "key", "name", "count", "score", "rank")


@query("SELECT doc_id, " + " + ".join(f"regexp_matches(n, '(?i)(^|[^A-Za-z0-9+#]){w}(s|es)?($|[^A-Za-z0-9+#])')::INT" for w in ("the", "and", "les")) + r" AS hits FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s*/\s*', '/', 'g'), '[\s\-‐-―_]+', ' ', 'g')) AS n FROM documents)")
def o5_11_keyword_hits(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", keywords.keyword_hits(F.col("text"), ["the", "and", "les"]).alias("hits"))


# -- lists, orders, sizes --------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 12")
def o5_5_most_common(spark, sf_dir):
    """O5.5: a top-12 report."""
    return state.most_common(read(spark, sf_dir, "events"), F.col("event_type"), 12, "event_type")


@query("SELECT event_type, CASE WHEN count(*) > 0 THEN floor(100.0 * sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*) + 0.5)::int ELSE 0 END AS pct FROM events GROUP BY 1")
def o5_13_percent(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    return g.select("event_type", parse.percent(F.col("k"), F.col("n")).alias("pct"))


@query(f"SELECT seq FROM (SELECT p_partkey AS seq, lower(concat_ws(' ', p_name, p_brand, 'Tejgaon', 'Dhaka', p_type)) AS hay FROM part) JOIN ({_GATED}) USING (seq) WHERE n_notes > 0 AND contains(hay, 'economy')")
def o3_6_search(spark, sf_dir):
    """O3.6: flagged postings that hold a query."""
    return state.visible(scored_parts(spark, sf_dir).withColumn("status", F.lit("")), "flagged", " ECONOMY ").select("seq")


def _ordered(spark, sf_dir, by):
    p = scored_parts(spark, sf_dir).withColumns({"deadline": F.when(F.col("seq") % 5 > 0, F.date_add(F.lit("2026-01-01").cast("date"), (F.col("seq") % 97).cast("int"))), "postedAt": F.when(F.col("seq") % 3 > 0, F.date_add(F.lit("2026-01-01").cast("date"), (F.col("seq") % 89).cast("int")))})
    return state.dashboard_order(p, by, "seq").limit(25).select("seq", (F.monotonically_increasing_id() + 1).alias("place"))


def _order_sql(order: str) -> str:
    return f'SELECT seq, place FROM (SELECT seq, row_number() OVER (ORDER BY {order}, seq) AS place FROM (SELECT g.*, round_even(p_retailprice * 20, 0) AS pay FROM ({_GATED}) g JOIN part ON seq = p_partkey)) WHERE place <= 25'


@query(_order_sql('"matchScore" DESC'))
def o7_5_best_match(spark, sf_dir):
    """O7.5: the first 25 of each order (pages of a dashboard)."""
    return _ordered(spark, sf_dir, "match")


@query(_order_sql("CASE WHEN seq % 3 > 0 THEN DATE '2026-01-01' + (seq % 89)::INT END DESC NULLS LAST"))
def o7_5_newest(spark, sf_dir):
    return _ordered(spark, sf_dir, "newest")


@query(_order_sql("CASE WHEN seq % 5 > 0 THEN DATE '2026-01-01' + (seq % 97)::INT END NULLS LAST"))
def o7_5_deadline(spark, sf_dir):
    return _ordered(spark, sf_dir, "deadline")


@query(_order_sql("pay DESC NULLS LAST"))
def o7_5_salary(spark, sf_dir):
    return _ordered(spark, sf_dir, "salary")


@query("SELECT doc_id, len(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: NOT contains('the and of in to', w)))) AS n_missing FROM documents WHERE text IS NOT NULL")
def o7_7_difference(spark, sf_dir):
    """O7.7: terms that are no part of an evidence text."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.size(state.terms_not_in(F.split(F.lower("text"), " "), "the and of in to")).cast("bigint").alias("n_missing"))


@query("SELECT doc_id, length('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}')::int AS chars FROM documents")
def o5_15_json_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", records.storage_size(F.struct("lang", "source")).alias("chars"))


@query("SELECT p_partkey, substr(p_name, 1, 9) AS a, substr(p_type, 1, 6) AS b FROM part")
def o8_15_truncate(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.truncated(F.col("p_name"), 9).alias("a"), text.truncated(F.col("p_type"), 6).alias("b"))


@query("SELECT o_orderkey, regexp_matches(o_orderdate::date::varchar, '^\\d{4}-\\d{2}-\\d{2}') AS iso FROM orders")
def o8_16_iso_date(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.has_iso_date(F.col("o_orderdate").cast("date").cast("string")).alias("iso"))


# -- comparisons -----------------------------------------------------------------------------


def part_facts(spark, sf_dir):
    p = part_postings(spark, sf_dir).withColumnRenamed("seq", "doc_id").withColumn("text", F.lit(None).cast("string"))
    return requirements.facts(p.withColumn("distanceKm", F.when(F.col("doc_id") % 3 > 0, F.col("distanceKm"))))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_size / 2.0 <= 10 THEN 'match' ELSE 'gap' END ELSE 'match' END AS place, CASE WHEN p_size % 8 <= 3 THEN 'match' ELSE 'gap' END AS years, CASE WHEN round_even(p_retailprice * 20, 0) >= 25000 THEN 'match' ELSE 'gap' END AS pay FROM part")
def o9_21_comparisons(spark, sf_dir):
    """O9.20, O9.21: place, years and pay of parts as postings."""
    d = part_facts(spark, sf_dir)
    return d.select("doc_id", requirements.compare_place(F.col("place"), ["Tejgaon"])["state"].alias("place"), requirements.compare_years(F.col("asks"), 3.0)["state"].alias("years"), requirements.compare_pay(F.col("pay"), 25000)["state"].alias("pay"))


# -- records ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name || ' - ' || CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown role' ELSE o_orderpriority END || ' - applied ' || strftime(o_orderdate::date, '%-d %b %Y') AS line FROM orders JOIN customer ON o_custkey = c_custkey")
def o9_44_version_line(spark, sf_dir):
    """O9.43, O9.44."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    title = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", records.version_line(F.col("c_name"), title, F.col("o_orderdate").cast("date")).alias("line"))


@query("SELECT p_partkey::VARCHAR AS \"jobId\", trim(p_brand) AS company, trim(p_name) AS title, p_retailprice::DOUBLE AS posted, '' AS url, '2026-10-10' AS \"appliedOn\", len(p_type)::INT AS n FROM part")
def o9_42_make_version(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("salaryMin"), "p_type")
    v = records.make_version(p, F.lit("2026-10-10 08:00:00").cast("timestamp"), keywordsAdded=F.array("p_type"))
    return v.select("jobId", "company", "title", F.col("salary.postedMin").alias("posted"), "url", "appliedOn", F.length(F.col("keywordsAdded")[0]).alias("n"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS email, turn % 3 = 0 AS overrides FROM conversations WHERE text IS NOT NULL AND (turn % 2 = 0 OR turn % 3 = 0)")
def o9_40_clean_private(spark, sf_dir):
    """O9.40: entries with a number in place of a text, or with texts missing, are no entries."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    t, n = F.col("text"), F.lit(None).cast("string")
    even, third = F.col("turn") % 2 == 0, F.col("turn") % 3 == 0
    pack_json = F.when(even, F.to_json(F.struct(t.alias("email"), F.lit(5).alias("recruiter")))).otherwise(F.to_json(F.struct(F.lit(5).alias("email"))))
    full = F.to_json(F.struct(*[F.when(third | (F.lit(k) != "summary"), F.lit(k)).otherwise(n).alias(k) for k in records.PRIVATE["resumeOverrides"]]))
    rows = c.select(F.struct("conv_id", "turn").alias("id"), F.concat(F.lit('{"applicationPack":'), pack_json, F.lit(',"resumeOverrides":'), full, F.lit("}")).alias("value"))
    return records.normalize_private(rows).select("id.*", F.col("applicationPack.email").alias("email"), F.col("resumeOverrides").isNotNull().alias("overrides"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(trim(coalesce(text, '')), {quoted('(?i)' + p)}) THEN '{n}'" for p, n in records.FIELDS) + " END AS field FROM documents")
def o9_41_field_of(spark, sf_dir):
    """O9.41: whole texts as labels, the first pattern that fits."""
    return read(spark, sf_dir, "documents").select("doc_id", records.field_of(F.col("text")).alias("field"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join("'cv'" if k == "cv" else f"CASE WHEN regexp_matches(coalesce(text, ''), {quoted('(?i)' + p)}) THEN '{k}' END" for k, _, p in fixed.DOCUMENTS) + "], lambda x: x IS NOT NULL), ',') AS docs, regexp_matches(coalesce(text, ''), " + quoted("(?i)" + fixed.DOCUMENTS[0][2]) + ") AS cv_named FROM documents")
def o9_29_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", pack.required_documents(F.col("text")).alias("d"))
    return d.select("doc_id", F.array_join(F.transform("d", lambda x: x["key"]), ",").alias("docs"), F.col("d")[0]["from_post"].alias("cv_named"))


# -- composed texts ---------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' student (degree expected 2027)' WHEN p_partkey % 3 = 1 THEN p_brand || ' student (degree expected May 2028)' ELSE p_brand || ' graduate' END AS label FROM part")
def o9_34_education_label(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 3
    label = pack.education_label(F.concat(F.lit("BSc in "), F.col("p_brand")), F.when(k == 1, "Expected May 2028").otherwise("2020"), F.when(k == 0, "2027"))
    return p.select("p_partkey", label.alias("label"))


@query(r"SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(replace('Dear All,' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || 'Sincerely,' || chr(10) || 'A B', chr(13), ''), '(?i)\A\s*Dear[^\n]*\n+', ''), '(?is)\n\s*(Sincerely|Best regards|Kind regards|Yours sincerely|Regards),?[ \t]*(\n.*|\s*)\z', ''), '\S+')) AS words FROM documents")
def o9_35_body_words(spark, sf_dir):
    letter = F.concat(F.lit("Dear All,\n\n"), text.text_or_empty(F.col("text")), F.lit("\nSincerely,\nA B"))
    return read(spark, sf_dir, "documents").select("doc_id", pack.body_words(letter).cast("bigint").alias("words"))


PERSON = {"personal": {"fullName": "Ada Nor"}, "education": [{"degree": "BSc in Physics", "date": "2020"}]}


@query("SELECT p_partkey, 'Hi [EDIT THIS: name], I have applied for the ' || p_name || ' role at ' || p_brand || '. I am a Physics graduate; we meet most in ' || p_type || '. I am happy to send my resume.' AS note FROM part")
def o9_27_recruiter_note(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.array("p_type").alias("overlap"))
    return p.select("p_partkey", pack.recruiter_note(PERSON).alias("note"))


@query("SELECT p_partkey, 'Application for ' || p_name || ' - Ada Nor' AS subject, 'Dear Hiring Team,' || chr(10) || chr(10) || 'I am applying for the ' || p_name || ' position at ' || p_brand || '. My resume is attached (cv.pdf).' || chr(10) || chr(10) || 'I am a Physics graduate; your post and my work meet most in ' || p_type || '.' || chr(10) || chr(10) || 'I can come for an interview when it suits you.' || chr(10) || chr(10) || 'Best regards,' || chr(10) || 'Ada Nor' AS body FROM part")
def o9_27_mail_draft(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.array("p_type").alias("overlap"), F.lit("cv.pdf").alias("file"), F.lit(False).alias("asks_letter"), F.lit("").alias("text"))
    return p.select("p_partkey", pack.mail_draft(PERSON).alias("m")).select("p_partkey", "m.subject", "m.body")


@query("SELECT o_orderkey, CASE WHEN d < 0 THEN 'warn' ELSE 'info' END AS state, CASE WHEN d < 0 THEN 'has passed' WHEN d = 1 THEN '1 day left' ELSE d || ' days left' END AS note FROM (SELECT o_orderkey, date_diff('day', DATE '1998-01-01', o_orderdate::date) AS d FROM orders)")
def o9_32_checklist(spark, sf_dir):
    none = F.lit("").alias("x")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("deadline"), F.lit("f").alias("file"), F.lit(False).alias("asks_letter"), F.struct(F.lit("").alias("text")).alias("letter"), F.struct(F.lit("").alias("text")).alias("mail"), F.lit("").alias("note"), F.lit("u").alias("url"), F.lit("").alias("apply_to"), F.expr("CAST(array() AS array<struct<key string, name string, from_post boolean>>)").alias("documents"), none)
    task = F.filter(pack.checklist(F.lit("1998-01-01").cast("date")), lambda t: t["key"] == "deadline")[0]
    return o.select("o_orderkey", task.alias("t")).select("o_orderkey", "t.state", "t.note")


# -- keywords of one person: decisions and needs ----------------------------------------------


def scored_keywords(spark, sf_dir):
    """Line items as keywords of their order: supplier as tier, return flag as source."""
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    mode = F.col("l_suppkey") % 5
    return li.select(
        "doc_id", "l_linenumber", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("rank"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("key"), F.col("l_partkey").cast("string").alias("display"), F.when(F.col("l_quantity") > 45, "degree").when(F.col("l_quantity") > 35, "soft").otherwise("tech").alias("kind"),
        F.when(mode < 2, "must").when(mode < 4, "important").otherwise("nice").alias("tier"), F.when(F.col("l_returnflag") == "R", "mined").otherwise("lexicon").alias("source"), F.when(F.col("l_linestatus") == "F", "skills").otherwise("none").alias("evidence"),
        (F.col("l_tax") > 0.06).alias("added"),
    )


_KW = """k AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS rank, l_partkey::VARCHAR AS display, CASE WHEN l_quantity > 35 THEN 'soft' ELSE 'tech' END AS kind, l_suppkey % 5 < 4 AS wanted, l_returnflag = 'R' AS mined, l_linestatus = 'F' OR l_tax > 0.06 AS own FROM lineitem WHERE l_quantity <= 45),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN wanted THEN CASE WHEN mined THEN 2 WHEN kind = 'soft' THEN 1 ELSE 0 END ELSE 3 END, rank) AS n FROM k)"""


@query(f"WITH {_KW} SELECT doc_id, coalesce(array_to_string(list(display ORDER BY n) FILTER (wanted AND n <= 3), ','), '') AS needs, coalesce(array_to_string((list(display ORDER BY n) FILTER (wanted AND n <= 3 AND own))[1:2], ','), '') AS overlap, coalesce(len(list(display) FILTER (own)), 0)::INT AS n_mine FROM n GROUP BY doc_id")
def o9_23_needs(spark, sf_dir):
    """O9.23: what each order's keywords need most, and what of it is there."""
    n = pack.needs(scored_keywords(spark, sf_dir))
    return n.select("doc_id", F.array_join("needs", ",").alias("needs"), F.array_join("overlap", ",").alias("overlap"), F.size("mine").alias("n_mine"))


@query("SELECT l_orderkey AS doc_id, (l_linenumber * 1000000 + l_partkey)::BIGINT AS rank FROM lineitem WHERE l_quantity <= 45 AND l_linenumber IN (1, 3)")
def o9_15_chosen(spark, sf_dir):
    """O9.15: keywords decided for, degrees never."""
    k = scored_keywords(spark, sf_dir)
    decided = k.where("l_linenumber IN (1, 3)").groupBy("doc_id").agg(F.collect_list("key").alias("added"))  # two of an order
    return pack.chosen(k, decided).where("added").select("doc_id", F.col("rank").cast("bigint").alias("rank"))
