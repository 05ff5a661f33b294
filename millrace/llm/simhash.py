"""SimHash near-deduplication with deletion-variant signatures.

Fingerprint: texts lower-case A-Z, words are runs without ASCII white space, shingles are
three words (repeats included) joined by a space; fewer words make one shingle, none the
fingerprint zero.  A bit is one if set in over half of the shingles' XXH64 (seed 42).

Two fingerprints with at most ``DISTANCE`` = 3 differing bits, cut into two halves of 32
bits, have a half that differs in at most one bit.  So each half is filed 32 times, each
time with one bit left out and its place named: two halves share such a key if and only if
they differ in at most that bit.  An equality join on keys gives every candidate, and the
whole distance is verified.

Only distinct fingerprints are compared, and they are the nodes of the components; a
document gets the smallest doc_id of its component.  Keys are sorted and their runs compared
where they lie.  A key that may have over ``BLOCK`` members (halves are counted, summed before
the shuffle) does not go to one task: its members are filed again by their other half without
one bit, and what is still large is cut into blocks compared two by two.  A task gives a
spanning forest of the links of a run, never all pairs.

Null texts count as empty, and empty ones are linked like others (fingerprint zero).  Texts
of any length are read whole.  A row without doc_id links like others; its component_id is the
smallest doc_id in its component, null where none has one.  Repeated rows and ties give equal
rows.  Extra columns are ignored by :func:`near_groups` and kept by :func:`drop_near_copies`,
which drops rows by doc_id and text: other texts under a doc_id stay, rows with the same
doc_id and text are one document.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, forest, materialise, run_bounds, spread_join, table, whole_groups

DISTANCE, SHINGLE, SEED, BLOCK = 3, 3, 42, 1024
#: Runs up to this size are compared column by column, longer ones as matrices.
FEW = 8
#: Tables of keys up to this number of rows (16 bytes each) are broadcast, longer ones dealt.
BROADCAST_KEYS = 1_000_000
#: Row b holds the bits of the byte b, the least first.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_bits(text: bytes | None, n: int = SHINGLE, at_once: int = 1 << 20) -> int:
    """The fingerprint of one text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    if len(words) > n:
        start, stop = start[: 1 - n], stop[n - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(start), at_once):
        a, b = start[at : at + at_once].tolist(), stop[at : at + at_once].tolist()
        h = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], "<u8")
        by_byte = h.view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(((ones * 2 > len(start)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def text_hash(text: Column) -> Column:
    """Tells texts under one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), h: one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([shingle_bits(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("h")], ["doc_id", "fp", "h"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"), text_hash(docs["text"]).alias("h"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, h bigint")


def variants(fps: DataFrame) -> DataFrame:
    """(fp) -> 64 rows each (key, fp): the place of the bit left out and the half without it."""
    cut = fps.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn(
        "half", F.when(F.col("v") < 32, F.expr("fp & 4294967295L")).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    )
    return cut.select(F.expr("shiftleft(cast(v AS bigint), 32) | (half & ~shiftleft(1L, v % 32))").alias("key"), "fp")


def _wanted(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs link under a key they share.  Equal halves meet under all 32 keys and
    count under the first; others meet where they differ."""
    v = key >> 32
    differ = ((a ^ b) >> np.where(v < 32, 0, 32).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return (np.bitwise_count(a ^ b) <= DISTANCE) & ((differ != 0) | (v % 32 == 0))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key, of bounded runs -> edges that span each run's links."""
    for t in whole_groups(batches, ["key"]):
        key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        start, stop = run_bounds(key)
        size, a, b = stop - start, [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for n in range(2, min(FEW, int(size.max())) + 1):  # runs of one size together
            at = start[size == n]
            for i in range(n - 1 if len(at) else 0):
                for j in range(i + 1, n):
                    x, y = fp[at + i], fp[at + j]
                    near = _wanted(key[at], x, y)
                    a.append(x[near])
                    b.append(y[near])
        for i, j in zip(start[size > FEW].tolist(), stop[size > FEW].tolist(), strict=True):
            own = fp[i:j]
            x, y = forest(own.view(np.int64), _wanted(key[i : i + 1], own[:, None], own[None, :]))
            a.append(x.view(np.uint64))
            b.append(y.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, low, high, block, fp) of hot keys, sorted by the first four -> edges."""
    for t in whole_groups(batches, ["key", "part", "low", "high"]):
        key, part, low, high, block, fp = (t.column(c).to_numpy() for c in ("key", "part", "low", "high", "block", "fp"))
        a, b = [], []
        for i, j in zip(*(x.tolist() for x in run_bounds(key, part, low, high)), strict=True):
            own = fp[i:j].view(np.uint64)
            near = _wanted(key[i : i + 1], own[:, None], own[None, :])
            if low[i] != high[i]:  # within a block they are compared elsewhere
                near &= block[i:j, None] != block[None, i:j]
            x, y = forest(fp[i:j], near)
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _hot_keys(fps: DataFrame) -> DataFrame:
    """(key): those that may have more than ``BLOCK`` members, and few others.  A key's members
    have one of two halves, so halves are counted: 2 rows a fingerprint, summed before the shuffle."""
    halves = fps.select(F.explode(F.expr("array(struct(0 AS top, fp & 4294967295L AS half), struct(1 AS top, shiftrightunsigned(fp, 32) AS half))")).alias("h")).select("h.*")
    many = halves.groupBy("top", "half").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 2)
    many = many.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return many.select(F.expr("shiftleft(cast(top * 32 + v AS bigint), 32) | (half & ~shiftleft(1L, v))").alias("key")).distinct()


def _hot_links(members: DataFrame) -> DataFrame:
    """Edges of hot keys (key, fp).  Their members differ in at most ``DISTANCE`` bits of the
    other half, so in at most one bit of one of its two parts of 16 bits: filed by these
    without one bit, as halves are; what is still large is cut into tiles."""
    other = F.expr("CASE WHEN shiftright(key, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    filed = members.withColumn("other", other).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(31))))
    filed = filed.withColumn("part", F.expr("shiftleft(cast(w AS bigint), 16) | (shiftright(other, w DIV 16 * 16) & 65535L & ~shiftleft(1L, w % 16))"))
    filed = materialise(filed.select("key", "part", "fp"), "simhash-hot")
    sizes = filed.groupBy("key", "part").agg(F.count("*").alias("n")).where("n > 1")
    tiles = filed.join(sizes, ["key", "part"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    tiles = tiles.withColumn("block", F.expr("pmod(xxhash64(fp), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tiles = tiles.select("key", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")
    by = ["key", "part", "low", "high"]
    return tiles.repartition(_tasks(members), *by).sortWithinPartitions(*by).mapInArrow(_tile_links, "a bigint, b bigint")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def link_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that span their links."""
    fps = fps.select("fp")
    hot = materialise(_hot_keys(fps), "simhash-hot-keys")
    n_hot = hot.count()
    keys = variants(fps.repartition(_tasks(fps)))  # as many tasks explode as there are cores for
    if not n_hot:
        return keys.repartition(_tasks(fps), "key").sortWithinPartitions("key").mapInArrow(_links, "a bigint, b bigint")
    few = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    cold = keys.join(few, "key", "left_anti").repartition(_tasks(fps), "key").sortWithinPartitions("key")
    return cold.mapInArrow(_links, "a bigint, b bigint").unionByName(_hot_links(keys.join(few, "key", "left_semi")))


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, h) of each row, and of each fingerprint its component's first document:
    (fp, n, component_id, keep_h), n the rows that have it."""
    fp = materialise(fingerprints(docs), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    reps = materialise(fp.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "simhash-distinct")
    comp = components(link_edges(reps), "simhash-components").withColumnRenamed("node", "fp")
    linked = reps.join(comp, "fp")  # fingerprints with a link only
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    low = linked.join(low, "root").select("fp", "low")
    named = reps.join(low, "fp", "left").withColumn("low", F.coalesce("low", "first"))
    return fp, materialise(named.select("fp", "n", F.col("low.doc_id").alias("component_id"), F.col("low.h").alias("keep_h")), "simhash-named")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable by links, itself included)."""
    fp, named = _labelled(docs)
    out = spread_join(fp, named, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their group's first document: the smallest doc_id (null
    after all others), of its texts the one with the least hash."""
    fp, named = _labelled(docs)
    gone = spread_join(fp, named, "fp", "n").where("NOT (doc_id <=> component_id AND h = keep_h)")
    gone = materialise(gone.select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct(), "simhash-gone")
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (text_hash(docs["text"]) == gone["_h"])
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, same, "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
