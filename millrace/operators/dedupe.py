"""Entity resolution: one row for postings that different boards carry.

Edges come from equal keys (each row to the first of its key) and from near copies within
one company, found by equality joins on rare title tokens and on variants of signatures.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import canonical_url, fingerprint, normalize_company, normalize_title, slug_tokens, slug_words, text_or_empty
from . import near
from .graph import components, materialise


def _signature(low: str) -> int:
    words = slug_words(low)
    if not words:
        return 0
    n = max(1, len(words) - 2)
    halves = b"".join([md5(b" ".join(words[i : i + 3])).digest()[8:] for i in range(n)])
    ones = np.unpackbits(np.frombuffer(halves, np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def simhash(text: Column) -> Column:
    """64-bit signature of three-word shingles (words over two characters), as a long.

    The low half of each shingle's MD5 votes on every bit; a tie is 0, no words give 0.  Votes
    are counted in numpy, a batch of texts at a time, and the slug is cut in the same pass.
    """

    @F.pandas_udf("bigint")
    def run(s):
        return s.map(_signature)

    return run(F.lower(text_or_empty(text)))


def canonical(postings: DataFrame) -> DataFrame:
    """Add the keys by which postings are compared; ``seq`` orders them."""
    company, title = normalize_company(F.col("company")), normalize_title(F.col("title"), True)
    p = postings.withColumns({"norm_company": company, "norm_title": title, "url_key": canonical_url(F.col("url"))})
    return p.withColumns(
        {
            "title_tokens": slug_tokens(F.col("norm_title")),
            "sim": simhash(F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.col("title"))),
            "fingerprint": fingerprint(F.col("norm_company"), F.col("norm_title"), F.col("area")),
        }
    )


def key_edges(keyed: DataFrame, key: str, node: str = "seq") -> DataFrame:
    """Each row to the first row of its non-blank key: as many edges as rows, not pairs."""
    first = keyed.where(F.col(key) != "").groupBy(key).agg(F.min(node).alias("b"))
    return keyed.join(first, key).select(F.col(node).alias("a"), "b").where("a <> b")


def title_nodes(keyed: DataFrame) -> DataFrame:
    """One row (seq, norm_company, tokens) for rows alike in company and title tokens, its first; written.
    Where rows are marked as ``fresh`` or not, a title is if all of its rows are."""
    fresh = [F.bool_and("fresh").alias("fresh")] if "fresh" in keyed.columns else []
    alike = keyed.groupBy("norm_company", F.array_sort("title_tokens").alias("tokens")).agg(F.min("seq").alias("seq"), *fresh)
    return materialise(alike.where(F.size("tokens") > 0), "titles")


def title_edges(titles: DataFrame, threshold: float = fixed.TITLE_JACCARD) -> DataFrame:
    """(a, b, jaccard), all pairs of titles of one company at or over the threshold, each once."""
    return near.close_pairs(titles.where("norm_company IS NOT NULL").withColumnRenamed("seq", "node"), ["norm_company"], threshold)


def title_links(titles: DataFrame, threshold: float = fixed.TITLE_JACCARD) -> DataFrame:
    """(a, b) that span the links of :func:`title_edges`: fewer than titles in each comparison, however
    many pairs there are."""
    return near.linked_sets(titles.withColumnRenamed("seq", "node"), ["norm_company"], threshold)


def text_edges(rows: DataFrame, distance: int = fixed.SIMHASH_DISTANCE) -> DataFrame:
    """(a, b) that span the links of rows (seq, norm_company, tokens, sim; perhaps fresh) of one company
    with a shared title token whose signatures differ in at most ``distance`` bits."""
    fresh = [c for c in rows.columns if c == "fresh"]
    rows = rows.where("sim <> 0").select("norm_company", "tokens", F.col("seq").alias("node"), F.col("sim").alias("sig"), *fresh)
    close = near.linked(rows.select("norm_company", "node", "sig", *fresh), ["norm_company"], distance)  # few have a near text in their company at all
    some = materialise(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-texts")
    return near.linked(rows.join(some, "node", "left_semi").withColumn("token", F.explode("tokens")), ["norm_company", "token"], distance)


def near_edges(keyed: DataFrame, threshold: float = fixed.TITLE_JACCARD, distance: int = fixed.SIMHASH_DISTANCE) -> DataFrame:
    """Edges that span the links of rows of one company with close titles, or with close texts and a
    shared title token.  Rows alike in company and title tokens are one node, their first row, before
    anything is compared; a row's edge to it stands for all pairs of such rows.  Where rows are marked as
    ``fresh`` or not, links among rows that are not are left out."""
    fresh = [c for c in keyed.columns if c == "fresh"]
    titles = title_nodes(keyed)
    first = titles.select(F.col("norm_company").alias("_c"), F.col("tokens").alias("_t"), F.col("seq").alias("node"))
    rows = keyed.join(first, (F.col("norm_company") == F.col("_c")) & (F.array_sort("title_tokens") == F.col("_t")))
    rows = materialise(rows.select("seq", "node", "norm_company", F.col("_t").alias("tokens"), "sim", *fresh), "title-rows")
    alike = rows.groupBy("norm_company", "tokens", F.col("node").alias("seq"), "sim")
    texts = alike.agg(F.bool_and("fresh").alias("fresh")) if fresh else alike.agg(F.count("*").alias("n")).drop("n")
    own = rows.where("seq <> node").select(F.col("seq").alias("a"), F.col("node").alias("b"))
    return title_links(titles, threshold).unionByName(text_edges(texts, distance)).unionByName(own).distinct()


def groups(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``group_id``, the first ``seq`` of its group."""
    edges = key_edges(keyed, "fingerprint").unionByName(key_edges(keyed, "url_key")).unionByName(near_edges(keyed))
    comp = components(edges, "dedupe").select(F.col("node").alias("seq"), "root")
    return keyed.join(comp, "seq", "left").withColumn("group_id", F.coalesce("root", "seq")).drop("root")


def merge_groups(grouped: DataFrame) -> DataFrame:
    """One row a group: the richest posting, its blanks filled from the others in order, all
    sightings kept.  Groups are summed with ordered minima, never gathered."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    first = lambda value, ok: F.min(F.when(ok, F.struct("seq", value)))
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    base = F.max_by(F.struct(*grouped.columns), F.struct(size("description"), size("requiredSkills"), -F.col("seq")))
    pay = F.struct("salaryMin", "salaryMax", "salaryText")
    agg = grouped.groupBy("group_id").agg(
        base.alias("base"),
        F.count("*").alias("n_merged"),
        first(pay.alias("v"), F.col("salaryMin").isNotNull()).alias("pay"),
        first(F.col("salaryText").alias("v"), has("salaryText")).alias("pay_text"),
        *[first(F.col(c).alias("v"), has(c)).alias(f"f_{c}") for c in ("deadline", "employmentType", "experienceText", "requiredSkills")],
        first(F.struct("area", "distanceKm").alias("v"), has("area")).alias("place"),
        F.min(F.when(has("postedAt"), F.col("postedAt"))).alias("posted"),
    )
    r = F.col("base")
    keep = lambda c: F.coalesce(F.when(r[c].cast("string") != "", r[c]), F.col(f"f_{c}.v"), r[c])
    own = F.coalesce(r["area"], F.lit("")) != ""
    fill = {c: keep(c) for c in ("deadline", "employmentType", "experienceText", "requiredSkills")}
    stated = r["salaryMin"].isNotNull()
    fill |= {
        "salaryMin": F.coalesce(r["salaryMin"], F.col("pay.v.salaryMin")),
        "salaryMax": F.when(stated, r["salaryMax"]).otherwise(F.coalesce(F.col("pay.v.salaryMax"), F.when(F.col("pay").isNull(), r["salaryMax"]))),
        "salaryText": F.coalesce(
            F.when(stated, F.nullif(r["salaryText"], F.lit(""))), F.when(~stated, F.nullif(F.col("pay.v.salaryText"), F.lit(""))),
            F.when(~stated & F.col("pay").isNull(), F.nullif(r["salaryText"], F.lit(""))), F.col("pay_text.v"), r["salaryText"],
        ),
        "area": F.when(own, r["area"]).otherwise(F.coalesce(F.col("place.v.area"), r["area"])),
        "distanceKm": F.when(own | F.col("place").isNull(), r["distanceKm"]).otherwise(F.col("place.v.distanceKm")),
        "postedAt": F.coalesce("posted", r["postedAt"]),
    }
    out = agg.select("group_id", "n_merged", *[fill.get(c, r[c]).alias(c) for c in grouped.columns if c not in ("group_id", "source", "sources")])
    return out.join(sightings(grouped), "group_id")


def sightings(grouped: DataFrame) -> DataFrame:
    """(group_id, sources, source): sightings distinct by source and url, first ones kept in order."""
    one = grouped.select("group_id", "seq", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("name"), "url", canonical_url(F.col("url")).alias("k"))
    first = one.groupBy("group_id", "name", "k").agg(F.min(F.struct("seq", "url")).alias("f"))
    # as long as the boards that carry one posting
    kept = first.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(F.col("f.seq").alias("seq"), F.col("name").alias("source"), F.col("f.url").alias("url")))).alias("s"))
    return kept.select("group_id", F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url"))).alias("sources"), F.array_join(F.array_sort(F.array_distinct(F.transform("s", lambda x: x["source"]))), " + ").alias("source"))


def deduplicate(postings: DataFrame) -> DataFrame:
    """Merged postings with ``n_merged``; ``seq`` (long, distinct) orders the input."""
    keyed = materialise(canonical(postings), "canonical")
    return merge_groups(materialise(groups(keyed), "groups")).orderBy(F.lower("company"), F.lower("title"), "seq")
