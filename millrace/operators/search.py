"""Substring search on a big feed by lists of trigrams.

:class:`TextIndex` keeps, for each three bytes of the lower-cased text and each block of ids, the ids that
hold them, sorted by trigram in files, so that a search reads the lists it needs by the files' own
statistics.  A search intersects the lists of its term block by block, the shortest first, and
only the rows left are read and tested.  Terms under three bytes test every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_or_empty

#: Ids of one block: so many consecutive ones, which bounds a list.
BLOCK_IDS = 1 << 16
#: Places (id, trigram) sorted at once, and bytes of a text read at once: tens of MB a worker.
MOST_HELD, PIECE = 1 << 20, 1 << 20
LISTS = "trigram int, block bigint, ids array<bigint>"


def trigrams(text: bytes) -> np.ndarray:
    """The distinct trigrams of a text as numbers, of a long one a piece at a time."""
    b, found = np.frombuffer(text, np.uint8), np.empty(0, np.int32)
    for lo in range(0, len(b) - 2, PIECE):
        own = grams(b[lo : lo + PIECE + 2])
        found = np.union1d(found, own) if len(found) else own
    return found


def listed(code: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Rows (LISTS) of places, ids ``of`` by trigram."""
    order = np.lexsort((of, code))
    code, of = code[order], of[order]
    block = of >> 16
    cut = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))) if len(code) else np.empty(0, np.int64)
    ids = pa.ListArray.from_arrays(pa.array(np.append(cut, len(code)), pa.int32()), pa.array(of)) if len(cut) else pa.array([], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(code[cut], pa.int32()), pa.array(block[cut]), ids], ["trigram", "block", "ids"])


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of some rows (id, t) at a time, so that the shuffle has a row a trigram, not one a place."""
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(), batch.column("t")
        own, held = [], 0
        for i in range(len(ids)):
            own.append(trigrams(texts[i].as_py()))
            held += len(own[-1])
            if held >= MOST_HELD or i + 1 == len(ids):
                yield listed(np.concatenate(own), np.repeat(ids[i + 1 - len(own) : i + 1], [len(x) for x in own]))
                own, held = [], 0


def grams(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:])


class TextIndex:
    """Lists of a feed under ``path``; ``key`` is a long, distinct and not null."""

    def __init__(self, spark: SparkSession, path: str, key: str, text: str) -> None:
        self.spark, self.path, self.key, self.text = spark, path, key, text

    def build(self, feed: DataFrame) -> None:
        """Index every row, whole texts."""
        rows = feed.select(F.col(self.key).cast("bigint").alias("id"), F.lower(text_or_empty(F.col(self.text))).cast("binary").alias("t"))

        parts = rows.mapInArrow(lists, LISTS).groupBy("trigram", "block").agg(F.flatten(F.collect_list("ids")).alias("ids"))  # BLOCK_IDS at most
        parts.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block").write.mode("overwrite").parquet(self.path)

    def candidates(self, term: str) -> DataFrame:
        """(id) of the rows that hold every trigram of a term of three bytes or more."""
        codes = [int(c) for c in trigrams(term.lower().encode())]
        found = self.spark.read.schema(LISTS).parquet(self.path).where(F.col("trigram").isin(codes))
        block = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists"))  # a term's
        block = block.where(F.size("lists") == len(codes))
        both = F.aggregate(F.slice("lists", 2, len(codes)), F.col("lists")[0]["ids"], lambda a, x: F.array_intersect(a, x["ids"]))
        return block.select(F.explode(both).alias("id"))

    def search(self, feed: DataFrame, term: str) -> DataFrame:
        """The rows of ``feed`` whose text holds ``term``, in any case: the same as ``contains``."""
        holds = F.contains(F.lower(text_or_empty(F.col(self.text))), F.lit(term.lower()))
        if len(term.lower().encode()) < 3:
            return feed.where(holds)
        found = self.candidates(term)
        return feed.join(found, feed[self.key] == found["id"], "left_semi").where(holds)
