"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Rows are cut into chunks.  A chunk hashes its texts to fingerprints that are just
   wide enough for the number of rows (log2 of it and ``SPARE_BITS`` more), sorts the
   distinct ones and writes, for each owner of a range of fingerprints, their gaps in
   Golomb-Rice code, with the doc_ids beside them in a table in the shared folder.
2. Only the codes travel to the owners.  An owner decodes its lists and answers each
   chunk with a bitmap that marks fingerprints met in another chunk.
3. Marked rows (and rows alike within a chunk) are suspects.  Their texts are grouped
   byte by byte, with partial sums before the shuffle, so that a text held by a third
   of all rows sends one row a task.  Chance equals of fingerprints part here.

Texts are equal when identical after ``normalise`` (nothing by default); null counts as
empty.  Of equal texts the row with the largest doc_id stays, and a null doc_id counts as
smaller than any other (a group without any other keeps it).  Rows that repeat with the
same doc_id and text are one document: all are returned, all count, and they are kept or
dropped alike.  Texts of any length are read whole.  Extra columns are ignored by :func:`exact_groups` and kept by
:func:`drop_copies`.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, spread_join, table

SPARE_BITS = 10
CHUNK_ROWS = 20_000
OWNER_ROWS = 500_000
#: Suspects up to this number (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
#: Rows to drop up to this number (40 bytes each) are broadcast; texts do not move then.
BROADCAST_GONE = 250_000


def rice_encode(sorted_values: np.ndarray, span: int) -> bytes:
    """Golomb-Rice code of sorted distinct values below ``span``: one byte for the
    parameter, four for the count, the unary parts of the gaps, then their low bits."""
    n = len(sorted_values)
    k = max(0, int(math.log2(max(1, span // max(1, n)))))
    gaps = np.diff(sorted_values.astype(np.int64), prepend=-1) - 1
    ends = np.cumsum((gaps >> k) + 1)  # each unary part: zeros, then a one
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return bytes([k]) + n.to_bytes(4, "little") + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    k, n, bits = code[0], int.from_bytes(code[1:5], "little"), int.from_bytes(code[5:13], "little")
    body = np.frombuffer(code, np.uint8, offset=13)
    cut = (bits + 7) // 8
    high = np.diff(np.flatnonzero(np.unpackbits(body[:cut], count=bits)), prepend=-1) - 1
    low = np.unpackbits(body[cut:], count=n * k).reshape(n, k).astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum((high << k) + low + 1) - 1


def _normalised(text: Column, normalise: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(text, F.lit(""))
    return normalise(text) if normalise else text


def suspects(docs: DataFrame, n_rows: int) -> DataFrame:
    """(doc_id, text) -> doc_ids whose text may have an equal.  Misses none."""
    bits = min(62, max(8, math.ceil(math.log2(n_rows + 1)) + SPARE_BITS))
    owners = max(1, n_rows // OWNER_ROWS)
    width = -(-(1 << bits) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def flush() -> pa.RecordBatch:
            h, ids = np.concatenate(hashes), pa.concat_arrays(keys)
            order = np.argsort(h, kind="stable")
            h, ids = h[order], ids.take(pa.array(order))
            chunk, rows = uuid.uuid4().hex, []
            cuts = np.searchsorted(h, np.arange(owners + 1, dtype=np.int64) * width)
            for owner in np.flatnonzero(np.diff(cuts)).tolist():
                own = h[cuts[owner] : cuts[owner + 1]]
                values, times = np.unique(own, return_counts=True)
                rows.append((chunk, owner, rice_encode(values - owner * width, width), times.astype("<u4").tobytes(), ids.slice(cuts[owner], len(own)).to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["chunk", "owner", "code", "times", "ids"])

        hashes, keys, size = [], [], 0
        for batch in batches:
            text = batch.column("text").to_pylist()
            hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(t) for t in text), np.uint64, len(text)) >> np.uint64(64 - bits))
            hashes[-1] = hashes[-1].astype(np.int64)
            keys.append(batch.column("doc_id"))
            size += len(text)
            if size >= CHUNK_ROWS:
                yield flush()
                hashes, keys, size = [], [], 0
        if size:
            yield flush()

    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sent = materialise(raw.mapInArrow(send, "chunk string, owner bigint, code binary, times binary, ids array<bigint>"), "fingerprints")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is owned whole: its lists are decoded, the values of one owner compared."""
        lists: dict[int, list[tuple[str, np.ndarray]]] = {}
        for batch in batches:
            for chunk, owner, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lists.setdefault(owner, []).append((chunk, rice_decode(code)))
        for owner, own in lists.items():
            values, times = np.unique(np.concatenate([v for _, v in own]), return_counts=True)
            again = values[times > 1]
            maps = [np.packbits(np.isin(v, again, assume_unique=True)).tobytes() for _, v in own]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own]), pa.array([owner] * len(own), pa.int64()), pa.array(maps, pa.binary())], ["chunk", "owner", "bitmap"])

    bitmaps = sent.select("chunk", "owner", "code").repartition(owners, "owner").mapInArrow(answer, "chunk string, owner bigint, bitmap binary")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bitmap, times, ids in zip(*(batch.column(c) for c in ("bitmap", "times", "ids")), strict=True):
                n = np.frombuffer(times.as_py(), "<u4")
                hit = np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8), count=len(n)).astype(bool) | (n > 1)
                yield pa.RecordBatch.from_arrays([ids.values.filter(pa.array(np.repeat(hit, n)))], ["doc_id"])

    return sent.select("chunk", "owner", "times", "ids").join(bitmaps, ["chunk", "owner"]).select("bitmap", "times", "ids").mapInArrow(mark, "doc_id bigint")


def exact_groups(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    d = docs.select("doc_id", _normalised(docs["text"], normalise).alias("text"))
    marked = materialise(suspects(d, d.count()).distinct(), "suspects")
    # few suspects: their ids go to every task and only their texts move; else both sides are dealt by id
    few = marked.count() <= BROADCAST_IDS
    again = d.join(F.broadcast(marked) if few else marked, d["doc_id"].eqNullSafe(marked["doc_id"]), "left_semi")
    # byte verification: grouped by the whole text, summed before the shuffle
    same = again.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialise(same.select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size", F.col("group_size").alias("n")), "groups")
    out = spread_join(d.select("doc_id", F.sha2("text", 256).alias("text_sha256")), groups, "text_sha256", "n")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    gone = exact_groups(docs, normalise).where("not kept").select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_sha"))
    gone = materialise(gone.distinct(), "gone")
    few = gone.count() <= BROADCAST_GONE
    # a doc_id, or null, may stand for several texts: only those of the text that is a copy go
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.unhex(F.sha2(_normalised(docs["text"], normalise), 256)) == gone["_sha"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
