"""Phrases of a post that no lexicon holds: runs of words that carry meaning, kept where the
post says that they matter.

A line is cut at punctuation; found lexicon wordings are taken out; what stands between stop
words is a run.  Runs of up to ``MOST_WORDS`` words are counted by document and stem, in two
grouped sums (by spelling, then by stem).  A phrase inside a longer one that was said as often
goes: longer phrases are filed under their parts, so this is a grouped sum and not a
comparison of all pairs.  Lines are cut in Arrow batches, as lambdas on each word were most of the
work; words are looked at once for each spelling in a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import fixed
from ..functions.text import text_or_empty
from . import keywords

MOST_WORDS, MOST_TERMS, GROUP = 4, 14, "Additional Skills"
#: Bytes of lines that are cut at a time.
BYTES = 4_000_000
#: Words that end a run, where the caller names no others: grammar, and what every post says.
STOP = (
    "a about above after all also am an and any are as at be been before being below between both but by can could did do does doing down during each either etc few for "
    "from further had has have having he her here him his how however i if in into is it its just like may me more most much must my need needs no nor not of off on once only onto "
    "or other our out over own per plus same she should so some such than that the their them then there these they this those through to too under until up upon us use used using "
    "very via was we were what when where which while who whom whose why will with within without would yet you your "
    "ability able candidate candidates company experience good great job knowledge preferred required requirements role skill skills strong team work working year years"
).split()


def cased(word: Column) -> Column:
    """As shown: short words and capitals as they are, others with a capital first."""
    return F.when(word.rlike("^[A-Z0-9&+]+$") | (F.length(word) < 3), word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000)))


def stem(phrase: Column) -> Column:
    """A phrase and its plural are one."""
    return F.regexp_replace(F.regexp_replace(phrase, "ies$", "y"), "([^s])s$", "$1")


def _cut(stop: frozenset[str]):
    """Lines, cut at ``|`` -> the runs of each."""

    stops = pa.array(sorted(stop), pa.string())

    def some(lines: pa.Array) -> pa.Array:
        split = pc.split_pattern(lines, " ")
        words = split.flatten().dictionary_encode()
        bare = pc.replace_substring_regex(pc.replace_substring_regex(words.dictionary, "^[^A-Za-z0-9+#]+|[^A-Za-z0-9+#]+$", ""), "'[sS]$", "")
        number = pc.and_not(pc.match_substring_regex(bare, "^[0-9]"), pc.match_substring_regex(bare, "^[0-9]+[A-Za-z]{1,3}$"))
        ends = pc.or_(pc.or_(pc.is_in(pc.utf8_lower(bare), stops), number), pc.equal(pc.utf8_length(bare), 1))
        ends = pc.or_(ends, pc.equal(words.dictionary, "|")).to_numpy(zero_copy_only=False)
        # 0 nothing, 1 a word, 2 the end of a run
        kinds = np.where(ends, 2, pc.not_equal(bare, "").to_numpy(zero_copy_only=False).astype(np.int8))
        ids, line = words.indices.to_numpy(), np.repeat(np.arange(len(lines), dtype=np.int32), pc.list_value_length(split).to_numpy())
        left = kinds[ids] > 0
        ids, line = ids[left], line[left]
        said = kinds[ids] == 1
        starts = said.copy()  # a word after none, after an end, or on a line of its own
        starts[1:] &= ~said[:-1] | (line[1:] != line[:-1])
        first = np.append(np.flatnonzero(starts[said]), said.sum()).astype(np.int32)
        found = pc.binary_join(pa.ListArray.from_arrays(first, bare.take(pa.array(ids[said]))), " ")
        ends = np.cumsum(np.bincount(line[starts], minlength=len(lines)))
        return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), found)

    @F.arrow_udf(ArrayType(StringType()))
    def cut(lines: pa.Array) -> pa.Array:
        at = np.flatnonzero(np.diff(np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False), dtype=np.int64) // BYTES)) + 1
        bounds = [0, *at.tolist(), len(lines)]
        return pa.chunked_array([some(lines.slice(i, j - i)) for i, j in zip(bounds, bounds[1:])], pa.list_(pa.string())).combine_chunks()

    return cut


def runs(lines: DataFrame, stop: list[str] = STOP) -> DataFrame:
    """(doc_id, seg, segment, tier, weight[, blank]) -> one row a run: doc_id, at, run, tier,
    weight, lead_in, short.  ``blank``: a pattern of wordings that are taken out."""
    text = keywords.norm(F.col("segment"))
    if "blank" in lines.columns:
        text = F.when(F.col("blank") != "", F.regexp_replace(text, F.col("blank"), F.lit(" | "))).otherwise(text)
    # norm leaves no blank but spaces, and a break takes every "|" that a line holds
    found = _cut(frozenset(stop))(F.regexp_replace(text, fixed.PHRASE_BREAK, " | "))
    short = (F.size(F.split("segment", r"\s+")) <= 4) & ~F.col("segment").rlike(fixed.SENTENCE_START)
    out = lines.select("doc_id", "seg", "tier", "weight", F.col("segment").rlike(fixed.LEAD_IN).alias("lead_in"), short.alias("short"), found.alias("found"))
    # outer, as else the optimizer puts a filter on the size before it, for which lines would be cut once more
    out = out.select("*", F.posexplode_outer("found").alias("pos", "run")).where("run IS NOT NULL").drop("found")
    return out.withColumn("at", F.shiftleft(F.col("seg").cast("bigint"), 24) + F.col("pos")).drop("seg", "pos")


def noted(found: DataFrame, skip: list[str] = (), company: str | None = None) -> DataFrame:
    """Runs that may be terms, with ``words``, ``key`` (stem), ``shown`` and ``shape``.

    Gone are runs of over MOST_WORDS words, those with a word of ``skip`` or of the column
    ``company``, and lone words that look neither like a name nor like a thing.
    """
    words, low = F.split("run", " "), F.split(F.lower("run"), " ")
    first = F.get(words, F.lit(0))
    acronym = first.rlike("^[A-Z][A-Z0-9&+]{1,6}$") & ~first.isin(fixed.PLAIN_ACRONYMS)
    shape = F.when(F.size(words) == 1, acronym | first.rlike("^[a-z]+[A-Z]|^[A-Z][a-z]+[A-Z]")).otherwise(F.forall(words, lambda w: w.rlike("^[A-Z0-9]")))
    d = found.withColumns({"words": F.size(words), "shape": shape, "key": stem(F.lower("run")), "shown": F.array_join(F.transform(words, cased), " ")})
    d = d.where((F.col("words") <= MOST_WORDS) & ((F.col("words") > 1) | F.col("shape") | ((F.length("run") >= 6) & F.col("run").rlike(fixed.NOUN_ENDING))))
    if skip:
        d = d.where(~F.arrays_overlap(low, F.array(*map(F.lit, skip))))
    if company:
        own = F.filter(F.split(F.lower(text_or_empty(F.col(company))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
        d = d.where(~F.arrays_overlap(low, own))
    return d


def accumulate(found: DataFrame) -> DataFrame:
    """One row a document and stem: name (the commonest spelling, the first of equals), count,
    score (the three greatest weights, one for several words, one for a shape), tier, ord
    (place of its first run among the document's stems) and whether the post points at it."""
    weights = [F.count_if(F.col("weight") == w).alias(f"w{w}") for w in (1, 2, 3)]
    spelled = found.groupBy("doc_id", "key", "shown").agg(
        F.count("*").alias("n"), F.min("at").alias("at"), *weights, F.min(keywords.tier_rank(F.col("tier"))).alias("r"), F.bool_or("lead_in").alias("lead_in"),
        F.bool_or(F.col("short") & (F.col("tier") != "important")).alias("short_line"), F.bool_or("shape").alias("shape"), F.max("words").alias("words"),
    )
    terms = spelled.groupBy("doc_id", "key").agg(
        F.max_by("shown", F.struct("n", -F.col("at"))).alias("name"), F.sum("n").alias("count"), F.min("at").alias("at"), *[F.sum(f"w{w}").alias(f"w{w}") for w in (1, 2, 3)],
        F.min("r").alias("r"), F.bool_or("lead_in").alias("lead_in"), F.bool_or("short_line").alias("short_line"), F.bool_or("shape").alias("shape"), F.max("words").alias("words"),
    )
    threes = F.least(F.lit(3), F.col("w3"))
    twos = F.least(3 - threes, F.col("w2"))
    ones = F.least(3 - threes - twos, F.col("w1"))
    score = 3 * threes + 2 * twos + ones + (F.col("words") >= 2).cast("int") + F.col("shape").cast("int")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    tier = F.element_at(F.array(*map(F.lit, ("must", "important", "nice"))), F.col("r") + 1)
    return terms.select("doc_id", "key", "name", "count", score.cast("bigint").alias("score"), tier.alias("tier"), place.alias("ord"), "words", "shape", (F.col("lead_in") | F.col("short_line")).alias("pointed_at"))


def accepted(terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """The ``most`` best terms of each document: said twice or pointed at (a lone plain word has to
    be pointed at), and not part of a longer one said as often."""
    lone = (F.col("words") == 1) & ~F.col("shape")
    ok = terms.where(F.col("pointed_at") | (~lone & (F.col("count") >= 2)))
    # a term and the parts of it meet at their keys in one grouped sum, so that terms are made once
    own, w = [c for c in ok.columns if c not in ("doc_id", "key")], F.split("key", " ")
    cuts = [(i, n) for n in range(1, MOST_WORDS) for i in range(1, MOST_WORDS - n + 2)]
    fits = lambda i, n: F.col("doc_id").isNotNull() & (n < F.size(w)) & (i + n - 1 <= F.size(w)) & (F.col("words") > 1)
    parts = F.array_compact(F.array(*[F.when(fits(i, n), F.array_join(F.slice(w, i, n), " ")) for i, n in cuts]))
    met = ok.select("doc_id", "key", F.struct(*own).alias("own"), F.explode(F.concat(F.array(F.lit(None).cast("string")), parts)).alias("part"))
    met = met.select("doc_id", F.coalesce("part", "key").alias("key"), F.when(F.col("part").isNull(), F.col("own")).alias("own"), F.when(F.col("part").isNotNull(), F.col("own.count")).alias("longer"))
    met = met.groupBy("doc_id", "key").agg(F.max("own").alias("own"), F.max("longer").alias("longer"))
    kept = met.where("own IS NOT NULL AND (longer IS NULL OR longer < own.count)").select("doc_id", "key", "own.*")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most)


def mined(docs: DataFrame, lexicon: DataFrame, stop: list[str] = STOP, skip: list[str] = fixed.PLACE_WORDS, most: int = MOST_TERMS, text: str = "text") -> DataFrame:
    """The best mined terms of each document (doc_id, text[, company])."""
    lines = keywords.tiered(keywords.governed(keywords.segments(docs, text), lexicon))
    found = keywords.hits(lines, lexicon).select("doc_id", "seg", "key").join(lexicon.select("key", "rank", "pattern"), "key")
    blank = found.groupBy("doc_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(-F.length("pattern"), "pattern"))), lambda x: x["pattern"]), "|").alias("blank"))  # one line's entries
    lines = lines.join(blank, ["doc_id", "seg"], "left").withColumn("blank", F.coalesce("blank", F.lit("")))
    r = runs(lines, stop)
    if "company" in docs.columns:
        r = r.join(docs.select("doc_id", "company"), "doc_id")
        return accepted(accumulate(noted(r, list(skip), "company")), most)
    return accepted(accumulate(noted(r, list(skip))), most)


def extract_all(docs: DataFrame, lexicon: DataFrame, stop: list[str] = STOP, skip: list[str] = fixed.PLACE_WORDS, **how) -> DataFrame:
    """All keywords of each document, ranked: the lexicon's and the best mined ones (kind "tech",
    of a group of their own).  Ties of score and tier go to the earlier found, then the lexicon's."""
    lex = keywords.extract(docs, lexicon, **how)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "entry")) - 1
    lex = lex.withColumns({"ord": place, "source": F.lit("lexicon"), "hardRequirement": F.col("yearsRequired").isNotNull()}).drop("at", "entry")
    own = mined(docs, lexicon, stop, skip, text=how.get("text", "text"))
    own = own.select(
        "doc_id", F.concat(F.lit("m:"), "key").alias("key"), F.col("name").alias("display"), "count", "score", F.lit(False).alias("inTitle"), F.lit(None).cast("int").alias("yearsRequired"), "tier",
        "name", F.lit("tech").alias("kind"), F.lit(GROUP).alias("grp"), F.lit(None).cast("string").alias("tag"), "ord", F.lit("mined").alias("source"), F.lit(False).alias("hardRequirement"),
    )
    every = lex.unionByName(own)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), keywords.tier_rank(F.col("tier")), "ord", "source")
    return every.withColumn("rank", F.row_number().over(w)).drop("ord")
