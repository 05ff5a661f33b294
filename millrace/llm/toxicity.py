"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded before matching: compatibility forms (NFKC), letters of other scripts that
look like Latin ones, digits and signs that stand for letters inside words, letters
stretched to three or more, zero-width characters, and marks where that makes an entry.

A lexicon entry is a word (bounded on both sides) or a stem (bounded on the left), with a
weight; an exception is a phrase that makes the entries inside it not count.  The automaton
finds all of them in one pass.  ``density`` = weight of the hits for each ``PER_WORDS``
words, where short texts count as ``LEAST_WORDS``; score = 1 - exp(-density * slope), with
the slope set so that the best threshold on the training rows scores one half.

:func:`learn` takes the weights from labelled rows: smoothed log-odds of the number of
documents with the word or stem, summed by grouped aggregation before they reach the
driver.  At most ``FIT_ROWS`` labelled rows are used (drawn by hash of doc_id), so entries,
each in ``LEAST_DOCS`` of them, are bounded too.  A phrase of two words whose first or second
is an entry, and that occurs among non-toxic rows only, becomes an exception; the slope is set
with the exceptions in place.

Null and empty texts score 0; texts of any length are read whole; a score of just one half
counts as toxic; a null doc_id is scored and never learned from; repeated rows score alike; extra
columns are kept.  An empty table gives no rows; with an empty or one-sided label table only the
seed entries count.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import labelled_sample, materialise, table

FIT_ROWS, LEAST_DOCS, LEAST_ODDS = 8_000, 6, 4.0
STEM_LENGTHS = (4, 5, 6, 8)
PER_WORDS, LEAST_WORDS = 100, 20

#: Letters that look like Latin ones, by the Latin letter.
LOOKALIKES = {
    "a": "аɑα", "b": "ЬЪв", "c": "сϲ", "d": "ԁɗ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іıιӏ", "j": "јϳ", "k": "кκ",
    "l": "ⅼ", "m": "мⅿ", "n": "пո", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "гʀ", "s": "ѕꜱ", "t": "тτ", "u": "υս", "v": "ѵν",
    "w": "ԝω", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
#: Digits and signs that stand for letters inside words.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
#: Seed entries with their weights, and seed exceptions.
SEED_WORDS = {"idiot": 2.0, "idiots": 2.0, "moron": 2.0, "morons": 2.0, "scum": 2.0, "loser": 1.5, "losers": 1.5, "worthless": 1.5, "pathetic": 1.5, "disgusting": 1.5, "stupid": 1.5}
SEED_EXCEPTIONS = ["idiot proof"]

_ZERO_WIDTH = {chr(c) for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_LOOKS = {c: latin for latin, group in LOOKALIKES.items() for c in group}
_SIGNS = "".join(map(re.escape, STAND_INS))
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_HINT = re.compile(rf"[{_SIGNS}](?=[a-z])")
_TOKEN = re.compile(rf"[a-z{_SIGNS}]+")
_STAND_IN = str.maketrans(STAND_INS)
_STRETCH = re.compile(r"([a-z])\1{2,}")
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@lru_cache(65536)
def _plain(c: str) -> str:
    """What one character beyond ASCII is read as: look-alikes first, then its
    compatibility form, a space if it is no letter, mark or digit."""
    if c in _ZERO_WIDTH:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    return "".join(_LOOKS.get(p, p) if p.isalnum() or unicodedata.combining(p) else " " for p in unicodedata.normalize("NFKC", c).lower())


@lru_cache(65536)
def _bare(word: str) -> str:
    """The word without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def fold(text: str, words: Container[str] = ()) -> str:
    """Folded words of ``text``, with one space between and around them.

    Marks are kept, as they tell words of many languages apart, except where the word
    without them is one of ``words``.
    """
    text = text.lower()
    if not text.isascii():
        text = _FOREIGN.sub(lambda m: _plain(m[0]), text)
    if _HINT.search(text):
        text = _TOKEN.sub(lambda m: m[0].translate(_STAND_IN) if _HINT.search(m[0]) else m[0], text)
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    if ((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] > 96)).any():
        raw = _STRETCH.sub(r"\1\1", text).encode()
    found = raw.translate(_TO_SPACE).split()
    if words and not raw.isascii():
        return f" {' '.join(w if w.isascii() or (x := _bare(w)) not in words else x for w in (f.decode() for f in found))} "
    return f" {b' '.join(found).decode()} "


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=lambda: dict(SEED_WORDS))
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=lambda: list(SEED_EXCEPTIONS))
    slope: float = 1.0

    def automaton(self):
        """Aho-Corasick automaton over folded entries; a space marks a bound."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, weight in self.words.items():
            a.add_word(f" {word} ", (len(word) + 2, weight))
        for stem, weight in self.stems.items():
            a.add_word(f" {stem}", (len(stem) + 1, weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        a.make_automaton()
        return a


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the folded text: the longest entry at each start, none inside an exception."""
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif start not in best or best[start][0] < end:
            best[start] = (end, weight)
    spared.sort()
    out, at, reach = [], 0, -1  # reach: how far the exceptions that begin up to here go
    for s, (e, w) in sorted(best.items()):
        while at < len(spared) and spared[at][0] <= s:
            reach, at = max(reach, spared[at][1]), at + 1
        if s >= reach:
            out.append((s, e, w))
    return out


def density(automaton, text: str | None, words: Container[str] = ()) -> float:
    folded = fold(text or "", words)
    found = sum(w for _, _, w in hits(automaton, folded))
    return found * PER_WORDS / max(LEAST_WORDS, folded.count(" ") - 1) if found else 0.0


def in_fold(doc_id: str, of: int, left_out: int) -> bool:
    return zlib.crc32(doc_id.encode()) % of == left_out


def learn(docs: DataFrame, labels: DataFrame, seed_words: dict[str, float] | None = None) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    lex = Lexicon(words=dict(SEED_WORDS if seed_words is None else seed_words))
    rows = labelled_sample(docs, labels, "toxic", FIT_ROWS)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        total = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = fold(text or "").split()
                own = {f" {w} " for w in words}
                own |= {f" {w[:k]}" for w in words for k in STEM_LENGTHS if len(w) > k}
                total[y] += 1
                for g in own:
                    counts.setdefault(g, [0, 0])[y] += 1
        counts[""] = total
        keys = list(counts)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([counts[g][y] for g in part], pa.int64()) for y in (1, 0))], ["gram", "bad", "good"])

    counted = rows.select("text", "toxic").mapInArrow(grams, "gram string, bad bigint, good bigint").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = materialise(counted.where((F.col("bad") >= LEAST_DOCS) | (F.col("gram") == "")), "grams")
    n = counted.where("gram = ''").first()
    if n is None or not n["bad"] or not n["good"]:
        return lex
    odds = F.log((F.col("bad") + 0.5) / (n["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (n["good"] + 1.0))
    top = counted.where(F.col("gram") != "").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    top = top.orderBy(F.desc("bad"), "gram").collect()  # of FIT_ROWS texts, each in LEAST_DOCS of them
    # a stem is kept when no shorter one covers it, a word when no stem does
    for r in sorted((r for r in top if not r["gram"].endswith(" ")), key=lambda r: (len(r["gram"]), r["gram"])):
        stem = r["gram"].strip()
        if not covered(stem, lex.stems):
            lex.stems[stem] = float(r["odds"])
    words = {r["gram"].strip(): float(r["odds"]) for r in top if r["gram"].endswith(" ")}
    # a stem that only one word supports is that word
    bad, inside = {r["gram"]: r["bad"] for r in top}, dict.fromkeys(lex.stems, 0)
    for w in words:
        for s in {w[:k] for k in STEM_LENGTHS} & inside.keys():
            inside[s] = max(inside[s], bad[f" {w} "])
    for stem in list(lex.stems):
        if inside[stem] >= 0.9 * bad[f" {stem}"]:
            del lex.stems[stem]
    lex.words |= {w: x for w, x in words.items() if not covered(w, lex.stems)}
    calibrate(lex, rows)
    return lex


def covered(word: str, stems: dict[str, float]) -> bool:
    """Whether a learned stem begins a word."""
    return any(word[:k] in stems for k in STEM_LENGTHS)


def neighbours(automaton, folded: str) -> set[str]:
    """The phrases of two words that hits form with the word before and the word after them."""
    out = set()
    for s, e, _ in hits(automaton, folded):
        e = folded.index(" ", max(s + 1, e - 1))
        stop = folded.find(" ", e + 1)
        before, after = folded[folded.rfind(" ", 0, s) + 1 : s], folded[e + 1 : stop if stop >= 0 else len(folded)]
        out |= {f"{before}{folded[s:e]}" if before else "", f"{folded[s + 1 : e]} {after}" if after else ""} - {""}
    return out


def calibrate(lex: Lexicon, rows: DataFrame) -> None:
    """Set exceptions, then the slope of the lexicon that has them, from the training rows
    (bounded by FIT_ROWS)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for batch in batches:
            own = [sorted(neighbours(a, fold(t or "", lex.words))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.string()))], ["y", "near"])

    kind = dict(rows.dtypes)["toxic"]
    phrases = rows.select("text", "toxic").mapInArrow(near, f"y {kind}, near array<string>").select("y", F.explode("near").alias("phrase"))
    phrases = phrases.groupBy("phrase").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).where((F.col("bad") == 0) & (F.col("n") >= LEAST_DOCS))
    lex.exceptions = sorted({*lex.exceptions, *(r["phrase"] for r in phrases.collect())})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([density(a, t, lex.words) for t in batch.column("text").to_pylist()], pa.float64())], ["y", "density"])

    got = rows.select("text", "toxic").mapInArrow(measure, f"y {kind}, density double").collect()  # two numbers a row
    y = np.array([r["y"] for r in got])
    d = np.array([r["density"] for r in got])
    order = np.argsort(d)
    d, y = d[order], y[order]
    # errors with the threshold below each density; the middle of the best gap
    wrong = np.concatenate([[0], np.cumsum(y)]) + ((y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)]))
    k = int(np.median(np.flatnonzero(wrong == wrong.min())))
    low, high = (d[k - 1] if k else 0.0), (d[k] if k < len(d) else d[-1] * 2)
    cut = max(1e-6, (low + high) / 2 if low > 0 else high / 4)
    lex.slope = float(np.log(2) / cut)


def score(docs: DataFrame, lex: Lexicon, text: str = "text", name: str = "tox_score") -> DataFrame:
    """``docs`` with the score (0 to 1) as column ``name``; a column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for batch in batches:
            s = [float(-np.expm1(-density(a, t, lex.words) * lex.slope)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    docs = docs.drop(name)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


TEST_FOLD = (5, 0)


def held_out(of: int, left_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == left_out, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Lexicon:
    labels = table(spark, sf_dir, "labels").where(~held_out(*TEST_FOLD))
    return learn(docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained(spark, docs, sf_dir))
    return out.select(
        "doc_id",
        held_out(*TEST_FOLD).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )
