"""Training-order materialisation: token-ID shards in the order training reads them.

1. Every text is encoded and its ids, closed by ``end_id``, are cut into sequences of
   ``length`` ids (the last one padded with ``end_id``).  They are written once to the shared
   folder, as unsigned 16-bit (or 32-bit) little-endian integers.
2. Sequences are numbered 0 .. n-1 by their place in that table: place in the file plus the
   rows of the files before.  The table stands for a run; a recomputed task reads it again.
3. A keyed Feistel network permutes the least rectangle near a square that holds n (halves are
   moved modulo its sides); a value past the end walks its cycle until it falls inside.  So each sequence has a slot of its own in
   0 .. n-1, computed alone, and another key gives another order (one an epoch).
4. Rows are dealt by shard (``slot // shard_slots``), sorted, and each shard is written as
   one file of records of one size (``stride`` bytes): slot s lies at byte
   (s % shard_slots) * stride of shard s // shard_slots.  A reader resumes at any slot.

The files are written by Spark's own text writer, whose line separator is two zero bytes that
end each record; so they go to any file system Spark writes to.  Null and empty texts are one
sequence of ``end_id``.  Rows without doc_id take part, repeated rows are separate sequences.
Other columns are not read.  An empty table gives no sequences.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import chunks, encoder, rank_file
from .shared import materialise, new_path, table

LENGTH, SHARD_SLOTS, ROUNDS, KEY = 512, 16_384, 4, "epoch-0"
#: The shards are written in so many runs one after another, each shuffling its part of the ids.
WAVES = 3
END_MARK = "\0\0"


def sequences(docs: DataFrame, ranks: str, length: int = LENGTH, end_id: int | None = None, text: str = "text") -> DataFrame:
    """(doc_id, part, n_tokens, ids): the fixed-length sequences of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        end = bpe.size if end_id is None else end_id
        kind = np.dtype("<u2") if max(end, bpe.size) < 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for at, texts in chunks(batch.column(text)):
                ids, bound = bpe.encode_batch(texts)
                n = np.diff(bound)
                parts = n // length + 1  # the end id takes a place
                out = np.full(int(parts.sum()) * length, end, kind)
                base = (np.cumsum(parts) - parts) * length
                out[np.arange(len(ids)) + np.repeat(base - bound[:-1], n)] = ids
                first = np.repeat(np.cumsum(parts) - parts, parts)
                part = np.arange(len(first)) - first
                filled = np.minimum(length, np.repeat(n + 1, parts) - part * length)
                size = length * kind.itemsize
                data = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((np.arange(len(part) + 1, dtype=np.int32) * size)), pa.py_buffer(out)])
                own = batch.column("doc_id").take(pa.array(np.repeat(np.arange(at, at + len(texts)), parts)))
                yield pa.RecordBatch.from_arrays([own, pa.array(part), pa.array(filled), data], ["doc_id", "part", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, "doc_id bigint, part bigint, n_tokens bigint, ids binary")


def numbered(seqs: DataFrame) -> DataFrame:
    """Add ``seq``, 0 .. n-1, to a Parquet table that has been written: place in its file
    plus the rows of the files before it.  Nothing is shuffled but a count for each file."""
    rows = seqs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # as many as tasks that wrote
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialise(files.select("_file", before.alias("_before")), "sequence-files")
    return rows.join(files, "_file").withColumn("seq", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    return [struct.unpack_from("<q", hashlib.sha256(f"{i}:{key}".encode()).digest())[0] for i in range(rounds)]


def sides(n: int) -> tuple[int, int]:
    """Sides of the least rectangle near a square that holds n values."""
    a = math.isqrt(max(1, n) - 1) + 1
    return a, max(1, -(-n // a))


def _round(k: int, side: int, left: bool) -> Callable[[Column], Column]:
    """One round under key ``k``: one half is moved by a hash of the other, modulo its side.
    It takes one parameter: Spark gives a second one the index."""

    def move(p: Column) -> Column:
        one, other = (p["l"], p["r"]) if left else (p["r"], p["l"])
        moved = F.pmod(one + F.pmod(F.xxhash64(other, F.lit(k)), F.lit(side)), F.lit(side))
        return F.struct((moved if left else p["l"]).alias("l"), (p["r"] if left else moved).alias("r"))

    return move


def _feistel(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """One pass over 0 .. a * b - 1, taken as pairs of a left half below a and a right one below b."""
    pair = F.struct(F.floor((x - x % b) / b).cast("bigint").alias("l"), (x % b).alias("r"))
    for i, k in enumerate(keys):  # a lambda's variable keeps each round's halves from being computed twice
        pair = F.transform(F.array(pair), _round(k, (b, a)[i % 2 == 0], i % 2 == 0))[0]
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def slots(rows: DataFrame, n: int, key: str = KEY, seq: str = "seq") -> DataFrame:
    """Add ``slot``, a permutation of 0 .. n-1 by ``seq``.

    The domain has fewer than sqrt(n) + 1 values too many, so a walk is hardly ever outside and
    soon inside again; it ends, as the value itself lies on its cycle.  Small n walk as many steps
    as the domain has values, others until being outside is beyond likelihood; :func:`placed`
    fails rather than give a slot outside.
    """
    (a, b), keys = sides(n), round_keys(key)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(_walk_steps(n, a * b))),
        _feistel(F.col(seq), a, b, keys),
        lambda x, _: F.when(x < n, x).otherwise(_feistel(x, a, b, keys)),
    )
    return rows.withColumn("slot", walk)


def _walk_steps(n: int, size: int) -> int:
    if n == 0 or size <= n:
        return 1
    return min(size, int(np.ceil(np.log(1e-18 / n) / np.log(1 - n / size))) + 1)


def placed(docs: DataFrame, ranks: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: str = KEY, path: str | None = None) -> tuple[DataFrame, int]:
    """(slot, shard, seq, doc_id, part, n_tokens, ids) in no order, and the number of shards.
    ``path``: the folder of the table of sequences."""
    seqs, path = sequences(docs, ranks, length), path or new_path(docs.sparkSession, "sequences")
    # small row groups: a task holds one while it writes
    seqs.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    seqs = docs.sparkSession.read.schema(seqs.schema).parquet(path)
    n = seqs.count()
    rows = numbered(seqs)
    rows = slots(rows, n, key).withColumn("shard", F.floor(F.col("slot") / shard_slots))
    rows = rows.withColumn("slot", F.when(F.col("slot") < n, F.col("slot")).otherwise(F.raise_error(F.lit("a slot lies outside; raise the steps of the walk"))))
    return rows.select("slot", "shard", "seq", "doc_id", "part", "n_tokens", "ids"), max(1, -(-n // shard_slots))


def dealt(rows: DataFrame, shards: int, first: int = 0) -> DataFrame:
    """One shard a partition, from shard ``first`` on, sorted by slot.  The bounds of the
    ranges are known, so nothing is sampled for them."""
    return rows.repartitionById(shards, (F.col("shard") - first).cast("int")).sortWithinPartitions("slot")


def ordered(docs: DataFrame, ranks: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: str = KEY) -> DataFrame:
    """(slot, shard, seq, doc_id, part, n_tokens, ids), dealt by shard and sorted by slot."""
    return dealt(*placed(docs, ranks, length, shard_slots, key))


def write_shards(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Write records as raw files ``path/shard=<k>/part-*``: ids, then two zero bytes.

    The writer asks for rows sorted by shard and, where they are not, sorts by it alone, and
    a sort by slot before that is optimised away; so the sort here begins with shard.
    """
    rows = rows.sortWithinPartitions("shard", "slot")
    rows.select("shard", F.col("ids").cast("string").alias("value")).write.mode(mode).option("lineSep", END_MARK).partitionBy("shard").text(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted as soon as it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_in_waves(rows: DataFrame, shards: int, path: str, waves: int = WAVES) -> None:
    """Write ``shards`` shards of ``rows`` (in no order) in ``waves`` runs, so that the disk
    holds the shuffled ids of one run at a time beside ``rows`` and the shards."""
    with _shuffles_removed(rows.sparkSession):
        bounds = [-(-shards * w // waves) for w in range(waves + 1)]
        for first, end in zip(bounds, bounds[1:], strict=False):
            if first < end:
                part = rows.where(F.floor(F.col("shard") * waves / shards) == first * waves // shards)
                write_shards(dealt(part, end - first, first), path, "append" if first else "error")


def read_shards(spark: SparkSession, path: str, stride: int, shard_slots: int = SHARD_SLOTS, start: int = 0) -> DataFrame:
    """(slot, ids) from slot ``start`` on; shards before it are not read."""
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # no sequence, no file
        return spark.createDataFrame([], "slot bigint, ids binary")
    files = files.select(F.col("shard").cast("bigint").alias("shard"), "content").where(F.col("shard") >= start // shard_slots)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                if len(data) % stride:
                    raise ValueError(f"shard {shard}: {len(data)} bytes are no records of {stride}")
                ids = np.ascontiguousarray(data.reshape(-1, stride)[:, : stride - len(END_MARK)])
                at = np.arange(len(ids) + 1, dtype=np.int32) * ids.shape[1]
                records = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(shard * shard_slots + np.arange(len(ids))), records], ["slot", "ids"])

    return files.mapInArrow(cut, "slot bigint, ids binary").where(F.col("slot") >= start)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards of ``documents``; each sequence with its slot, its place in the shards
    and a digest of the record that the files hold there (null if they hold none)."""
    own, path = new_path(spark, "sequences"), new_path(spark, "shards")
    rows, shards = placed(table(spark, sf_dir, "documents"), rank_file(), path=own)
    places = materialise(rows.drop("ids"), "places")
    write_in_waves(rows, shards, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)  # the shards hold the ids now, and places the rest
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    stride = LENGTH * 2 + len(END_MARK)
    records = read_shards(spark, path, stride).select("slot", F.md5("ids").alias("record_md5"))
    return places.join(records, "slot", "left").select("slot", "shard", ((F.col("slot") % SHARD_SLOTS) * stride).alias("byte_offset"), "doc_id", "part", "n_tokens", "record_md5")


def materialise_order(docs: DataFrame, ranks: str, path: str | None = None, **how) -> str:
    """Write the shards of ``docs``; the folder they lie in."""
    path = path or new_path(docs.sparkSession, "shards")
    write_in_waves(*placed(docs, ranks, **how), path)
    return path
