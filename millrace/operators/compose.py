"""Texts made from a posting, a profile and its keywords, within limits of length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip_accents, text_or_empty

MOST_LETTER_WORDS, LEAST_LETTER_WORDS, MOST_NOTE_CHARS = 180, 120, 300
LABEL_STOP = "and the for with into onto from your our this that these those".split()
DOCUMENTS = fixed.DOCUMENTS


def listed(items: Column) -> Column:
    """"a", "a and b", "a, b and c"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(F.lit(0), n - 1)), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def article(word: Column) -> Column:
    return F.when(F.lower(word).rlike("^[aeiou]"), "an").otherwise("a")


def with_stop(c: Column) -> Column:
    return F.when(c.rlike("[.!?]$") | (c == ""), c).otherwise(F.concat(c, F.lit(".")))


def lower_first(c: Column) -> Column:
    """First letter small, unless the first word begins with two capitals or more that stand as a word, or
    holds two capitals behind its first letter."""
    return F.when(c.rlike(r"^[A-Z]{2,}\b") | c.rlike(r"^\S[^\sA-Z]*[A-Z][^\sA-Z]*[A-Z]"), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000)))


def clip_chars(c: Column, n: int) -> Column:
    """At most ``n`` characters; what is cut goes back to the end of a word."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n - 1), r"\s+\S*$", ""), F.lit("…")))


def clip_clause(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at the last clause or word end inside them."""
    head = F.substring(c, 1, n)
    clause, word = F.regexp_extract(head, r"^(.*)[,;:.]\s", 1), F.regexp_extract(head, r"^(.*)\s", 1)
    return F.when(F.length(c) <= n, c).when(F.length(clause) * 2 >= n, clause).when(word != "", word).otherwise(head)


def first_within(variants: list[Column], fits) -> Column:
    """The first variant that fits, else the last one."""
    return F.coalesce(*[F.when(fits(v), v) for v in variants], variants[-1])


def file_slug(c: Column, otherwise: str) -> Column:
    s = F.trim(F.regexp_replace(F.lower(strip_accents(text_or_empty(c))), "[^a-z0-9]+", " "))
    return F.when(s == "", otherwise).otherwise(F.replace(s, F.lit(" "), F.lit("-")))


def file_name(company: Column, title: Column, day: Column, kind: str = "resume", suffix: str = "pdf") -> Column:
    return F.concat(F.concat_ws("_", F.lit(kind), file_slug(company, "company"), file_slug(title, "role"), F.date_format(day, "yyyy-MM-dd")), F.lit(f".{suffix}"))


def shown_day(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def label_words(c: Column) -> Column:
    """Distinct words of a label over two letters that are no grammar, singular."""
    words = F.filter(F.split(F.lower(text_or_empty(c)), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*LABEL_STOP))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "ies$", "y"), "([^s])s$", "$1")))


def placed(categories: list[tuple[str, list[str]]], keywords: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, rank, key, display, grp) and the profile's categories with their items -> (doc_id,
    category, items) of each document, in order.

    Keywords are placed by rank, one after another: one that stands in some category under any of
    its wordings stays there; else it joins the category that shares most label words with its
    group, the first of equals; else its group becomes a category, which later ones may join."""
    wordings: DataFrame | None = lexicon and lexicon.groupBy("key").agg(F.collect_list(F.lower(F.regexp_replace("alias", r"[\s_-]+", " "))).alias("words"))
    k = keywords.join(wordings, "key", "left") if wordings is not None else keywords.withColumn("words", F.lit(None).cast("array<string>"))
    group = F.coalesce("grp", F.lit("Additional Skills"))
    k = k.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "display", group.alias("grp"), label_words(group).alias("label"), F.coalesce("words", F.array().cast("array<string>")).alias("words")))).alias("ks"))  # one post's
    plain = lambda x: F.lower(F.regexp_replace(F.trim(x), r"[\s_-]+", " "))
    kind = "array<struct<category string, label array<string>, items array<string>>>"
    start = F.array(*[F.struct(F.lit(c).alias("category"), label_words(F.lit(c)).alias("label"), F.array(*map(F.lit, items)).cast("array<string>").alias("items")) for c, items in categories]).cast(kind) if categories else F.array().cast(kind)

    def step(at: Column, k: Column) -> Column:
        here = F.exists(at, lambda g: F.exists(g["items"], lambda i: (plain(i) == plain(k["display"])) | F.array_contains(k["words"], plain(i))))
        shared = F.transform(at, lambda g: F.size(F.array_intersect(g["label"], k["label"])))
        best = F.array_max(shared)
        into = F.array_position(shared, best).cast("int") - 1  # the first of equals
        joined = F.transform(at, lambda g, i: F.struct(g["category"].alias("category"), g["label"].alias("label"), F.when(i == into, F.array_append(g["items"], k["display"])).otherwise(g["items"]).alias("items")))
        more = F.array_append(at, F.struct(k["grp"].alias("category"), k["label"].alias("label"), F.array(k["display"]).alias("items")))
        return F.when(here, at).when(F.coalesce(best, F.lit(0)) > 0, joined).otherwise(more)

    out = k.select("doc_id", F.posexplode(F.aggregate("ks", start, step)).alias("pos", "g"))
    return out.select("doc_id", "pos", "g.category", "g.items")


def resume_text(headline: Column, sections: Column) -> Column:
    """Plain text of a document: a headline, then (title, lines) sections; blank ones are skipped."""
    shown = F.filter(sections, lambda s: F.size(F.filter(s["lines"], lambda x: x != "")) > 0)
    return F.concat_ws("\n\n", headline, F.array_join(F.transform(shown, lambda s: F.concat(F.upper(s["title"]), F.lit("\n"), F.array_join(F.filter(s["lines"], lambda x: x != ""), "\n"))), "\n\n"))


def joined(parts: list[Column], sep: str = " | ") -> Column:
    """Parts that are not blank."""
    return F.array_join(F.filter(F.array(*[text_or_empty(p) for p in parts]), lambda x: x != ""), sep)
