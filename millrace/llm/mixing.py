"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: sources share ``share`` times all words by weight; a target stops at ``most``
   times its source's size and the excess goes to the others (water level, found in one
   ordered pass over the sources).
2. The mix is counted in blocks of equal numbers of words.  Blocks are seats: each goes to
   the source with the highest quotient target / (2k - 1).  Seats that any divisor near the
   final one would give are counted at once; only the quotients around it are ranked.
3. A source's seats go in the same way to its shards (hash of the draw, of bounded size, so
   a source with a third of all rows is many shards): integer quotas.
4. A shard lays its documents in an order drawn by seed and takes its quota's first blocks,
   after whole passes over the shard where the quota exceeds it.  A document at the edge is
   taken in part.

Sizes are words (runs without ASCII white space; null: 0), whole texts however long.  A null
source is a source of its own, last in order; ties of quotients go to the first source or
shard.  The draw hangs on seed, doc_id, source and text alone, so reruns agree; rows without
doc_id are drawn like others.  Rows that repeat in all three lie next to each other: they are summed
before the shuffle and drawn as one row of so many copies, however many there are.  Extra
columns are ignored by :func:`mix` and kept by :func:`mixed_texts`.  An empty table gives an
empty mix.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix-1"
SHARD_WORDS, LEVELS, COPIES_AT_ONCE = 2_000_000, 4096, 4096
#: A block is this part of the smallest target, within the bounds.
BLOCK_PART, BLOCK_BOUNDS = 200, (1, 1024)


def seats(rows: DataFrame, by: str, weight: str, total: str, key: str) -> DataFrame:
    """Add ``seats``: ``total`` (of each ``by``) dealt by Sainte-Laguë to the rows by ``weight``.

    A row's seats are floor(w / d + 1/2) for the divisor d that makes them add up; d lies
    between W / (S + n/2) and W / (S - n/2), so all but about n quotients are settled.  Of
    these, the level at which the seats run out is found by counts of ``LEVELS`` levels, and
    only the quotients of that level are ranked.  ``rows`` should be a written table.
    """
    whole = rows.groupBy(by).agg(F.sum(weight).cast("double").alias("_w"), F.count("*").alias("_n"))
    r = rows.join(whole, by)
    around = lambda sign: F.when(F.col("_w") > 0, F.floor(F.col(weight) * F.greatest(F.lit(0.0), F.col(total) + sign * F.col("_n") / 2) / F.col("_w") + 0.5)).otherwise(F.lit(0))
    r = r.withColumn("_low", F.greatest(F.lit(0).cast("bigint"), around(-1) - 1)).withColumn("_high", F.greatest(F.col("_low"), around(1) + 1))
    r = materialise(r.drop("_w", "_n"), "mix-quotients")
    rest = r.where(F.col(weight) > 0).select(by, key, weight, F.explode(F.expr("sequence(_low + 1, _high + 1)")).alias("_k"))
    rest = rest.select(by, key, (F.col(weight) / (F.col("_k") * 2 - 1)).alias("_q"))
    span = rest.groupBy(by).agg(F.max("_q").alias("_top"), (F.max("_q") - F.min("_q")).alias("_span"))
    open_ = r.groupBy(by).agg((F.max(total) - F.sum("_low")).alias("_open")).join(span, by)
    level = F.when(F.col("_span") > 0, F.floor((F.col("_top") - F.col("_q")) / F.col("_span") * LEVELS)).otherwise(F.lit(0))
    rest = rest.join(open_, by).withColumn("_level", level)
    counts = rest.groupBy(by, "_level").agg(F.max("_open").alias("_open"), F.count("*").alias("_here"))  # LEVELS + 1 a group
    higher = F.sum("_here").over(Window.partitionBy(by).orderBy("_level")) - F.col("_here")
    at = counts.withColumn("_higher", higher).where("_higher < _open").groupBy(by).agg(F.max("_level").alias("_last"), F.max("_higher").alias("_settled"))
    rest = rest.join(at, by).where("_level <= _last")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_q"), F.col(key)))
    ranked = rest.where("_level = _last").withColumn("_rank", rank).where("_rank <= _open - _settled")
    won = rest.where("_level < _last").select(by, key).unionByName(ranked.select(by, key)).groupBy(by, key).agg(F.count("*").alias("_won"))
    return r.join(won, [by, key], "left").withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_low", "_high", "_won")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> number ``s`` and ``target`` of each source."""
    one = Window.partitionBy(F.lit(0))
    w = sizes.withColumn("s", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("s") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * most)
    # sources reach their caps in the order of cap / weight; with those before this one capped,
    # the water stands at ``level``; past the first source that is not full it only falls
    order = one.orderBy(F.col("cap") / F.col("w"), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(one) * F.lit(share)
    w = w.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    w = w.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(one))
    return w.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("w"))).select("s", "source", "source_size", "target")


def _draw(docs: DataFrame, seed: str) -> Column:
    """Place of a row in the drawn order: a hash of seed, doc_id, source and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), part(docs["doc_id"]), F.lit(":"), part(docs["source"]), F.lit(":"), F.md5(F.coalesce(docs["text"], F.lit("")))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, and how it is taken:
    ``times`` whole and ``from_word`` to ``to_word`` once more."""
    d = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"), _draw(docs, seed).alias("draw"))
    d = materialise(d.groupBy("doc_id", "source", "size", "draw").agg(F.count("*").alias("copies")), "mix-sizes")
    src = materialise(targets(d.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most), "mix-targets")
    low, high = BLOCK_BOUNDS
    dealt = src.crossJoin(
        F.broadcast(src.agg(  # one row
            F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))) / BLOCK_PART))), F.lit(low)).cast("bigint").alias("block"),
            F.sum("target").alias("_total"),
        ))
    ).withColumn("all", F.lit(0)).withColumn("_seats", F.round(F.col("_total") / F.col("block")).cast("bigint"))
    src = seats(materialise(dealt, "mix-blocks"), "all", "target", "_seats", "s").select("s", "source", "source_size", "target", "block", F.least(F.col("seats"), F.floor(F.col("source_size") * most / F.col("block"))).alias("source_seats"))
    src = materialise(src, "mix-seats")

    d = d.join(src.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    d = d.withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint") % shards)
    own = d.groupBy("s", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"), F.first("source_seats").alias("_seats"), F.first("block").alias("block"))
    own = materialise(own, "mix-shards")
    quota = seats(own, "s", "shard_size", "_seats", "shard").select(F.col("s").alias("_s"), F.col("shard").alias("_shard"), "shard_size", F.least(F.col("seats") * F.col("block"), F.col("shard_size") * most).alias("words"))
    d = d.drop("block").join(materialise(quota, "mix-quotas"), (F.col("s") == F.col("_s")) & (F.col("shard") == F.col("_shard")))
    w = Window.partitionBy("s", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("at", F.sum(F.col("size") * F.col("copies")).over(w) - F.col("size") * F.col("copies"))
    # copies one by one again: runs of COPIES_AT_ONCE, then what is in a run
    end = F.col("copies") - 1
    d = d.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), end, F.lit(COPIES_AT_ONCE).cast("bigint"))))
    d = d.withColumn("_copy", F.explode(F.sequence("_run", F.least(end, F.col("_run") + COPIES_AT_ONCE - 1))))
    d = d.withColumn("at", F.col("at") + F.col("_copy") * F.col("size"))
    d = d.withColumn("times", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("bigint"))
    d = d.withColumn("to_word", F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("times") * F.col("shard_size") - F.col("at"))))
    return d.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("to_word")).alias("taken"), "times", F.lit(0).cast("bigint").alias("from_word"), "to_word", "source", "s", "shard", "draw")


def mixed_texts(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, whole ones as often as taken, and the words
    taken in part as a shorter text.

    Rows meet what is taken of them by their draw.  Rows alike in doc_id, source and text have
    one draw; together they are taken as ``mix`` says, one after another.
    """
    m = mix(docs, seed=seed, **how).where("taken > 0").groupBy(F.col("draw").alias("_draw"))
    m = m.agg(F.max("times").alias("_times"), F.max("size").alias("_size"), F.sum("to_word").alias("_words"))
    d = docs.withColumn("_draw", _draw(docs, seed))
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_draw").orderBy("_draw")))
    d = d.join(m, "_draw").withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_words") - (F.col("_nth") - 1) * F.col("_size"))))
    d = d.withColumn("_take", F.explode(F.expr("concat(array_repeat(_size, cast(_times AS int)), filter(array(_part), x -> x > 0))")))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("_take") < F.col("_size"), F.array_join(F.slice(words, F.lit(1), F.col("_take").cast("int")), "")).otherwise(F.col("text"))
    return d.withColumn("text", cut).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _seats_sql(rows: str, by: str, weight: str, total: str, key: str) -> str:
    around = lambda sign: f"CASE WHEN sum({weight}) OVER g > 0 THEN floor({weight} * greatest(0.0::DOUBLE, {total} + {sign} * (count(*) OVER g) / 2.0::DOUBLE) / (sum({weight}) OVER g)::DOUBLE + 0.5::DOUBLE) ELSE 0 END"
    return f"""(WITH r0 AS (SELECT *, greatest(0, {around(-1)} - 1)::BIGINT AS lo, {around(1)} AS hi0 FROM {rows} WINDOW g AS (PARTITION BY {by})),
 r AS (SELECT *, greatest(lo, hi0 + 1)::BIGINT AS hi, {total} - sum(lo) OVER (PARTITION BY {by}) AS open FROM r0),
 q AS (SELECT {by} AS g, {key} AS k, open, {weight}::DOUBLE / (2 * unnest(range(lo + 1, hi + 2)) - 1) AS q FROM r WHERE {weight} > 0),
 won AS (SELECT g, k, count(*) FILTER (n <= open) AS won FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY q DESC, k) AS n FROM q) GROUP BY g, k)
 SELECT r.* EXCLUDE (lo, hi, hi0, open), r.lo + coalesce(won.won, 0) AS seats FROM r LEFT JOIN won ON r.{by} = won.g AND r.{key} = won.k)"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}:' || coalesce('=' || doc_id::VARCHAR, 'null') || ':' || coalesce('=' || source, 'null') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM s1),
s3 AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(s - 1) % {len(WEIGHTS)} + 1] AS w, source_size * {MOST} AS cap FROM s2),
s4 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(w) OVER (ORDER BY cap::DOUBLE / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s3),
s5 AS (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS water FROM s4),
s6 AS (SELECT s, source, source_size, CASE WHEN cap <= level * w THEN cap::DOUBLE ELSE water * w END AS target FROM s5),
b AS (SELECT coalesce(least({BLOCK_BOUNDS[1]}, greatest({BLOCK_BOUNDS[0]}, floor(min(CASE WHEN target > 0 THEN target END) / {BLOCK_PART}))), {BLOCK_BOUNDS[0]})::BIGINT AS block, sum(target) AS total FROM s6),
s7 AS (SELECT s6.*, b.block, 0 AS one, round(b.total / b.block)::BIGINT AS blocks FROM s6, b),
s8 AS (SELECT * EXCLUDE (seats), least(seats, floor(source_size * {MOST}::DOUBLE / block))::BIGINT AS quota FROM {_seats_sql('s7', 'one', 'target', 'blocks', 's')}),
e AS (SELECT d.*, s8.s, source_size, target, block, quota, ('0x' || substr(draw, 1, 8))::BIGINT % greatest(1, ceil(source_size::DOUBLE / {SHARD_WORDS}))::BIGINT AS shard FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source),
h1 AS (SELECT s, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota, any_value(block) AS block FROM e GROUP BY s, shard),
h2 AS (SELECT s, shard, shard_size, least(seats * block, shard_size * {MOST}) AS words FROM {_seats_sql('h1', 's', 'shard_size', 'quota', 'shard')}),
t AS (SELECT e.*, shard_size, words, sum(size) OVER (PARTITION BY e.s, e.shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS at_word, CASE WHEN shard_size > 0 THEN floor(words::DOUBLE / shard_size)::BIGINT ELSE 0 END AS times FROM e JOIN h2 ON e.s = h2.s AND e.shard = h2.shard)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, words - times * shard_size - at_word)))::BIGINT AS taken FROM t
"""
