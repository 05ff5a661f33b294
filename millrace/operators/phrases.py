"""Phrases of a table of any size found in texts: a hashed index of word runs.

A phrase is a run of words.  Its hash is set in a filter of at most ``MOST_BITS`` bits, which the
tasks hold; they hash every run of a text's words that is as long as some phrase and keep those the
filter lets through, one row a run.  Only these are shuffled, by an equality join with the phrases, so
the shuffle grows with what is found, not with words times wordings.  A run that many texts hold
gets its phrases by broadcast.  Callers test what has met on the text itself, so chance
equals of hashes do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import haversine_km
from ..functions.text import slug, text_or_empty
from .graph import materialise
from .keywords import norm

#: Bits of the filter for each phrase, and at most (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
#: A run is hot from this number of rows on, and so many are at most.
HOT_ROWS, HOT_RUNS = 10_000, 10_000
WORD = "[a-z0-9+#]+"
#: Words a task remembers the hashes of.
MOST_WORDS = 200_000
#: Bytes of text that are cut into words, and handed on with their runs, at a time.
MOST_BYTES = 4 << 20
_STEP, _ALL = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


class Words:
    """Numbers of words met so far, and for each its hash and those without a plural ending (0: none)."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes: list[tuple[int, int, int]] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        for w in set(words) - self.number.keys():
            self.number[w] = len(self.hashes)
            self.hashes.append((_hash(w), _hash(w[:-1]) if w.endswith("s") else 0, _hash(w[:-2]) if w.endswith("es") else 0))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) if word else 0


def _run_hash(words: list[str]) -> int:
    """Hash of a run: its words but the last as digits of a number, then the last one and the length."""
    out = 0
    for w in words[:-1]:
        out = (out * int(_STEP) + _hash(w)) & _ALL
    out = (out * int(_STEP) + _hash(words[-1]) + len(words)) & _ALL
    return out ^ (out >> 29)


def _runs(texts: list[list[str]], lengths: list[int], words: Words, plural: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of all runs of the given lengths; with ``plural`` also without endings of the last word."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    number = words.numbers([w for t in texts for w in t])
    text = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(number))  # words from here to the text's end
    h = np.array(words.hashes, np.uint64).reshape(-1, 3)[number]
    for n in lengths:
        at = np.flatnonzero(left >= n)
        out = np.zeros(len(at), np.uint64)
        for k in range(n - 1):
            out = out * _STEP + h[at + k, 0]
        for ending in range(3 if plural else 1):
            last = h[at + n - 1, ending]
            ok = last != 0
            x = out[ok] * _STEP + last[ok] + np.uint64(n)
            yield text[at[ok]], x ^ (x >> np.uint64(29))


def with_hash(phrases: DataFrame, phrase: Column, word: str = WORD) -> DataFrame:
    """Add ``run`` and ``n``, hash and number of a phrase's words (lower case); phrases without words go."""

    @F.pandas_udf("struct<run bigint, n int>")
    def run(s):
        import pandas as pd

        words = [re.findall(word, x) for x in s]
        runs = np.array([_run_hash(w) if w else 0 for w in words], np.uint64).view(np.int64)
        return pd.DataFrame({"run": runs, "n": [len(w) for w in words]})

    return phrases.withColumn("_r", run(F.lower(text_or_empty(phrase)))).select("*", "_r.run", "_r.n").drop("_r").where("n > 0")


def filter_bits(phrases: DataFrame) -> np.ndarray:
    """The filter over ``run`` as bytes; its size is a power of two, at most MOST_BITS bits."""
    n = phrases.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(15, (n * BITS_EACH - 1).bit_length()))
    place = F.explode(F.array(*[F.expr(f"({x} & {bits - 1}L) + 1") for x in ("run", "shiftrightunsigned(run, 32)")]))
    parts = phrases.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in parts.collect():  # 4 KB for each 32,768 bits
        out[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return out.ravel()


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 8 - 1)
    hit = np.ones(len(h), bool)
    for p in (h & mask, (h >> np.uint64(32)) & mask):
        hit &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _cuts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together, of a row at least."""
    ends, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


def runs_found(rows: DataFrame, text: str, phrases: DataFrame, word: str = WORD, plural: bool = False) -> DataFrame:
    """``rows`` once for each distinct run of words of ``text`` (lower case) that may be a phrase, with ``run``."""
    bits = rows.sparkSession.sparkContext.broadcast(filter_bits(phrases))
    lengths = sorted(r[0] for r in phrases.select("n").distinct().collect())  # lengths of phrases
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in (b.slice(i, j - i) for b in batches for i, j in _cuts(sizes(b), MOST_BYTES)):
            if len(words.hashes) > MOST_WORDS:
                words = Words()
            texts = [re.findall(word, t.lower()) if t else [] for t in batch.column(place).to_pylist()]
            at, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for i, h in _runs(texts, lengths, words, plural):
                ok = _passes(bits.value, h)
                at.append(i[ok])
                found.append(h[ok])
            i, h = np.concatenate(at), np.concatenate(found)
            order = np.lexsort((h, i))
            i, h = i[order], h[order]
            first = np.append(True, (i[1:] != i[:-1]) | (h[1:] != h[:-1])) if len(i) else np.zeros(0, bool)
            i, h = i[first], h[first].view(np.int64)
            for m, n in _cuts(sizes(batch)[i], MOST_BYTES):  # a text goes out once a run
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(i[m:n])).columns, pa.array(h[m:n])], names)

    def sizes(batch: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64

    names = [*rows.columns, "run"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["run bigint"])
    return rows.mapInArrow(run, schema)


def met(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """The rows of :func:`runs_found` with the phrases of their runs, hot runs apart."""
    found = materialise(found, "runs")
    often = found.groupBy("run").agg(F.count("*").alias("n_rows"))
    total = found.count()
    hot = often.where(F.col("n_rows") >= max(HOT_ROWS, -(-total // HOT_RUNS))).select("run")  # HOT_RUNS at most
    hot = materialise(phrases.join(hot, "run"), "hot-phrases")
    rest = found.join(F.broadcast(hot.select("run").distinct()), "run", "left_anti").join(phrases, "run")
    return rest.unionByName(found.join(hot, "run").select(*rest.columns))


def hits(segs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As :func:`..operators.keywords.hits`, for a lexicon of any size: (doc_id, seg, key, alias), the longest
    alias of each entry that a segment holds.  ``lexicon`` has key, alias, rank and pattern."""
    aliases = materialise(with_hash(lexicon.select("key", "alias", "rank", "pattern"), norm(F.col("alias"))), "aliases")
    s = segs.select("doc_id", "seg", norm(F.col("segment")).alias("line"))
    both = met(runs_found(s, "line", aliases, plural=True), aliases).where(F.rlike("line", F.col("pattern")))
    return both.groupBy("doc_id", "seg", "key").agg(F.min_by("alias", "rank").alias("alias"))


#: What counts as a word in a slug.
SLUG_WORD = "[^ ]+"


def longest_places(rows: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """(key, name, lat, lon) of rows whose ``text`` names a place, the longest; of equally long ones the first
    in order.  ``places``: name (a slug), lat, lon."""
    p = materialise(with_hash(places.select("name", "lat", "lon"), F.col("name"), SLUG_WORD), "places")
    hay = rows.select(key, slug(F.col(text)).alias("hay"))
    both = met(runs_found(hay, "hay", p, SLUG_WORD), p)
    both = both.where(F.contains(F.concat(F.lit(" "), "hay", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" "))))
    best = both.groupBy(key).agg(F.min(F.struct((-F.length("name")).alias("l"), "name", "lat", "lon")).alias("b"))
    return best.select(key, "b.name", "b.lat", "b.lon")


def resolve_places(rows: DataFrame, key: str, places: DataFrame, home: tuple[float, float], remote: str, location: str = "location", description: str = "description", opening: int | None = 600) -> DataFrame:
    """(key, area, km, remote): the longest place name of a table in the location, else in the opening of the
    description (None: all of it), else remote work, else blank.  ``key`` is distinct.

    Distances are from ``home``; a row whose place is unknown has none, unless it is remote.
    """
    text = text_or_empty(F.col(description))
    r = rows.select(key, text_or_empty(F.col(location)).alias("_l"), (F.substring(text, 1, opening) if opening else text).alias("_d"))
    first = materialise(longest_places(r, key, "_l", places), "in-location")
    rest = longest_places(r.join(first, key, "left_anti"), key, "_d", places)
    named = r.join(first.unionByName(rest), key, "left")
    is_remote = F.concat_ws(" ", "_l", "_d").rlike(rf"(?i)\b({remote})\b")
    km = haversine_km(F.lit(home[0]), F.lit(home[1]), F.col("lat"), F.col("lon"))
    known = F.col("name").isNotNull()
    area = F.when(known, F.initcap("name")).when(is_remote, "Remote").otherwise("")
    return named.select(key, area.alias("area"), F.when(known, km).when(is_remote, 0.0).alias("km"), is_remote.alias("remote"))
