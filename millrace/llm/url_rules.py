"""URL filters: fixed host rules, and association rules mined by FP-growth.

Mining: every labelled page is a basket of the tokens of its url (:func:`tokens_of`) that
enough bad pages have, and of the item ``bad`` where its label says so.  Tokens that the very same
pages have are one item, and a token that only bad pages have is a rule at once and no part of
longer ones (none could be surer).  FP-growth finds combinations of the other items; of those that
imply ``bad``, the ones with enough support, confidence and lift remain, and a rule is pruned when
a shorter one inside it is at least as confident.  What remains is told token by token again.

Matching: each rule is filed once, under its rarest token (an inverted index).  Tokens of
the distinct urls meet the index by an equality join, and the candidate rule's other tokens
are verified against the url's.  Fixed rules (host and path start) come first: the longest
that fits decides; without one the url is blocked if a mined rule matches, else allowed.

A page's label is the row of ``labels`` whose doc_id is its page_id.  A null url, or one
without ``://``, has empty host and path, no tokens, and is allowed; urls of any length are read
whole.  Repeated pages and pages without id are judged like others; of several mined rules that
match, the surest one's confidence is told (ties are equal); of fixed rules of one length the
last in the alphabet decides.  Extra columns are ignored.  No pages give no rows; without
labels, or without bad ones, no rule is mined.  All of it is DataFrame functions and Spark's
FP-growth.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table

MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, LEAST_PAGES = 0.002, 0.6, 1.5, 8
BAD = "bad"
#: Fixed rules of the registered query: host and path, and their verdict.
FIXED_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url, sorted: an empty array where there is no host.

    ``host:`` the host, ``end:`` its last label, ``name:`` the words of its other labels,
    ``part:`` the segments of the path (digits as 0), ``word:`` the words of segments that are
    not one word, ``field:`` the names of query fields.  None is implied by each other one's
    spelling but ``host:``, so combinations do not say one thing several times.
    """
    host, path = host_of(url), ascii_lower(path_of(url))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words_in = lambda c: F.filter(F.split(c, r"[^\p{L}]+"), lambda x: F.length(x) > 1)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    mixed = F.filter(segments, lambda x: F.rlike(x, F.lit(r"[^\p{L}]")))
    fields = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x))
    every = F.concat(
        named("host", F.array(host)),
        named("end", F.slice(labels, F.greatest(F.lit(1), F.size(labels)), F.lit(1))),
        named("name", words_in(F.array_join(F.slice(labels, F.lit(1), F.greatest(F.lit(0), F.size(labels) - 1)), "."))),
        named("part", F.transform(segments, lambda x: F.regexp_replace(x, r"\d+", "0"))),
        named("word", words_in(F.array_join(mixed, "/"))),
        named("field", F.transform(fields, ascii_lower)),
    )
    return F.when((host == "") | url.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Rules (rule long, items array, confidence, support): urls with all items tend to be bad.

    ``pages`` (page_id, url), ``labels`` (page_id, bad boolean).  A page is bad if any of its
    labels says so; rows of ``pages`` that repeat are pages of their own.
    """
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.where("url IS NOT NULL").select("page_id", "url").join(known, "page_id")
    rows = materialise(rows.select("bad", tokens_of(F.col("url")).alias("tokens")).where(F.size("tokens") > 0).repartition(tasks), "url-tokens")
    n = rows.count()
    empty = pages.sparkSession.createDataFrame([], "rule bigint, items array<string>, confidence double, support double")
    if not n:
        return empty
    least = math.ceil(max(min_support * n, least_pages))
    base = rows.where("bad").count() / n
    # a token of too few bad pages is in no rule; tokens of the same pages (as many, of one sum
    # of hashes without carry) are one item
    each = rows.withColumn("page", F.monotonically_increasing_id()).select("page", "bad", F.explode("tokens").alias("token"))
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "page")).alias(f"sum{k}") for k in (1, 2)]
    tokens = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *sums).where(F.col("n_bad") >= least)
    items = tokens.groupBy("n", "n_bad", "sum1", "sum2").agg(F.min("token").alias("item"), F.collect_set("token").alias("members"))  # tokens of one url
    items = materialise(items.select("item", "members", (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / n).alias("support")), "url-items")
    enough = F.greatest(F.lit(min_confidence), F.lit(min_lift * base))
    sure = items.where((F.col("confidence") == 1) & (F.col("confidence") >= enough)).select(F.array("item").alias("items"), "confidence", "support")
    open_ = items.where("confidence < 1")
    baskets = each.join(open_.select(F.col("item").alias("token")), "token").groupBy("page").agg(F.max("bad").alias("bad"), F.collect_set("token").alias("items"))  # one url's tokens
    baskets = baskets.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = materialise(baskets, "baskets")
    kept = baskets.count()
    found = sure
    if kept:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / kept), minConfidence=min_confidence, numPartitions=tasks).fit(baskets.repartition(tasks))
        mined = model.associationRules.where(F.array_contains("consequent", BAD)).where(F.col("confidence") >= min_lift * base)
        found = found.unionByName(mined.select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("support") * (kept / n)).alias("support")))
    # a rule is needless when a part of it is as confident; parts of a rule are found by a join on their first item
    found = materialise(found.withColumn("rule", F.xxhash64("items")), "rules")
    short = found.select(F.col("items").alias("part"), F.col("confidence").alias("part_confidence"), F.element_at("items", 1).alias("first"))
    long = found.select("rule", "items", "confidence", F.explode("items").alias("first"))
    needless = long.join(short, "first").where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("part_confidence") >= F.col("confidence")))
    short = found.join(needless.select("rule").distinct(), "rule", "left_anti")
    # each item told by each of its tokens
    told = short.select("rule", "confidence", "support", F.posexplode("items").alias("at", "item")).join(items.select("item", "members"), "item")
    told = told.groupBy("rule").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.transform(F.array_sort(F.collect_list(F.struct("at", "members"))), lambda x: x["members"]).alias("of"))
    one = F.array(F.array().cast("array<string>"))
    every = F.aggregate("of", one, lambda done, own: F.flatten(F.transform(done, lambda d: F.transform(own, lambda x: F.concat(d, F.array(x))))))
    told = told.select(F.explode(every).alias("items"), "confidence", "support").withColumn("items", F.array_sort("items"))
    return told.select(F.xxhash64("items").alias("rule"), "items", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url) distinct, rules -> (url, confidence of the surest rule that matches)."""
    toks = urls.select("url", tokens_of(F.col("url")).alias("tokens"))
    wanted = rules.select(F.explode("items").alias("token")).distinct()
    each = toks.select("url", "tokens", F.explode("tokens").alias("token"))
    rare = each.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("rule", "items", "confidence", F.explode("items").alias("token")).join(rare, "token", "left")
    filed = filed.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("k"), F.first("items").alias("items"), F.first("confidence").alias("confidence"))
    index = filed.select(F.col("k.token").alias("token"), "items", "confidence")
    hit = each.join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0)
    return hit.groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer ones are asked first
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str]] = FIXED_RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, confidence (of the mined rule)."""
    found = matched(pages.where("url IS NOT NULL").select("url").distinct(), rules).withColumnRenamed("url", "_url")
    out = pages.select("page_id", "url").join(found, F.col("url") == F.col("_url"), "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", host.alias("host"), path.alias("path"), "confidence").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    rules = materialise(mine(pages, labels), "url-rules")
    return judge(pages, rules)


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}]+'), lambda x: len(x) > 1)"
_MIXED = r"array_to_string(list_filter(segments, lambda x: regexp_matches(x, '[^\p{L}]')), '/')"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_FIXED = sorted(((*r.partition("/")[::2], r, what) for r, what in FIXED_RULES), key=lambda x: (-len(x[2]), x[2]))

#: Mining by counting every combination of every labelled page's tokens; for tables small enough.
OP2_SQL = rf"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LOWER}), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels, list_filter(string_split(translate(path, {_LOWER}), '/'), lambda x: x <> '') AS segments FROM p),
t AS (SELECT page_id, url, host, path, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_concat(['host:' || host], list_transform(labels[-1:], lambda x: 'end:' || x),
  list_transform({_WORDS.format("array_to_string(labels[:-2], '.')")}, lambda x: 'name:' || x),
  list_transform(segments, lambda x: 'part:' || regexp_replace(x, '\d+', '0', 'g')),
  list_transform({_WORDS.format(_MIXED)}, lambda x: 'word:' || x),
  list_transform(regexp_extract_all(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'field:' || translate(x, {_LOWER}))))) END AS tokens FROM c),
known AS (SELECT doc_id, bool_or(bad) AS bad FROM (SELECT doc_id, quality = 0 OR toxic = 1 AS bad FROM labels) WHERE doc_id IS NOT NULL AND bad IS NOT NULL GROUP BY doc_id),
rows AS (SELECT bad, tokens FROM t JOIN known ON page_id = doc_id WHERE len(tokens) > 0),
n AS (SELECT greatest({MIN_SUPPORT} * count(*), {LEAST_PAGES}) AS least, greatest({MIN_CONFIDENCE}, {MIN_LIFT} * avg(bad::INT)) AS sure FROM rows),
often AS (SELECT token FROM (SELECT unnest(tokens) AS token FROM rows WHERE bad) GROUP BY token HAVING count(*) >= (SELECT least FROM n)),
baskets AS (SELECT bad, list_intersect(tokens, (SELECT coalesce(list(token), []) FROM often)) AS items FROM rows),
sets AS (SELECT bad, list_filter(list_sort(items), lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM (SELECT bad, items, unnest(range(1, 1 << len(items))) AS mask FROM baskets)),
found AS (SELECT items, avg(bad::INT) AS confidence FROM sets GROUP BY items HAVING sum(bad::INT) >= (SELECT least FROM n) AND avg(bad::INT) >= (SELECT sure FROM n)),
rules AS (SELECT * FROM found r WHERE NOT EXISTS (SELECT 1 FROM found o WHERE len(o.items) < len(r.items) AND list_has_all(r.items, o.items) AND o.confidence >= r.confidence)),
hit AS (SELECT url, max(confidence) AS confidence FROM (SELECT DISTINCT url, tokens FROM t WHERE url IS NOT NULL) JOIN rules ON list_has_all(tokens, items) GROUP BY url),
j AS (SELECT page_id, host, path, confidence, CASE {" ".join(f"WHEN {_FITS.format(h, '/' + s)} THEN '{r}'" for h, s, r, _ in _FIXED)} END AS rule FROM t LEFT JOIN hit ON t.url = hit.url)
SELECT page_id, host, path, rule, CASE rule {" ".join(f"WHEN '{r}' THEN '{w}'" for _, _, r, w in _FIXED)} ELSE CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END END AS verdict, confidence FROM j
"""
