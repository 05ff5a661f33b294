"""Entity resolution kept up day by day.

A store holds the postings seen so far by their keys, and which entity each belongs to.  A day's
postings meet only the stored rows that share a key with them: the same fingerprint, the same
url, or the same company, within which links with a fresh title or text are sought.  What they link
merges entities.  An entity is named after its first posting, so of entities that merge one name
stays; the others are renamed in a table of names, and no member is written again.

An entity is new only on the day none of its members was known before, whatever fingerprint its
richest posting has by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable
from . import dedupe
from .graph import components, materialise

KEYS = "id string, seq bigint"
NODES = "id bigint, norm_company string, title_tokens array<string>, sim bigint, seq bigint"
ENTITIES = "seq bigint, entity bigint"
NAMES = "entity bigint, now bigint"


class EntityStore:
    """Tables under ``root``, in hash buckets of which a day rewrites those its rows fall into.

    ``keys``: fingerprints and urls with their first posting.  ``nodes``: the distinct titles and texts of
    companies.  ``entities``: each posting's entity on its own day.  ``names``: entities that were merged since,
    and what they are called now.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, spread: int = 4):
        self.spark = spark
        self.keys = BucketTable(spark, f"{root}/keys", "id", KEYS, buckets)
        self.nodes = BucketTable(spark, f"{root}/nodes", "id", NODES, buckets, "norm_company", spread)
        self.entities = BucketTable(spark, f"{root}/entities", "seq", ENTITIES, buckets)
        self.names = BucketTable(spark, f"{root}/names", "entity", NAMES, buckets)

    def members(self) -> DataFrame:
        """(seq, entity): every posting's entity by its present name."""
        names = self.names.read()
        return self.entities.read().join(names, "entity", "left").select("seq", F.coalesce("now", "entity").alias("entity"))

    def _key_edges(self, ids: DataFrame) -> DataFrame:
        """Fresh postings to the first posting of each of their keys, stored or of today."""
        first = ids.groupBy("id").agg(F.min("seq").alias("today"))
        known = self.keys.lookup(ids).select("id", F.col("seq").alias("stored"))
        first = first.join(known, "id", "left").select("id", F.coalesce("stored", "today").alias("b"))
        return ids.join(first, "id").select(F.col("seq").alias("a"), "b").where("a <> b")

    def _near_edges(self, keyed: DataFrame) -> DataFrame:
        """Links by title and text within today's companies, each with a row of today."""
        columns = ["seq", "norm_company", "title_tokens", "sim"]
        stored = self.nodes.lookup(keyed).select(*columns, F.lit(False).alias("fresh"))
        return dedupe.near_edges(stored.unionByName(keyed.select(*columns, F.lit(True).alias("fresh"))))

    def add(self, postings: DataFrame) -> DataFrame:
        """Take in a day's postings (``seq`` distinct over all days) and return (seq, entity, is_new): their
        entities, and whether none of an entity's members was known before.

        Tables are written in an order in which a day that broke off may be added again: what later days
        meet comes last.
        """
        keyed = materialise(dedupe.canonical(postings).select("seq", "norm_company", "title_tokens", "sim", "fingerprint", "url_key"), "day")
        key = lambda kind, c: keyed.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.concat(F.lit(f"{kind}:"), c).alias("id"), "seq")
        ids = materialise(key("f", "fingerprint").unionByName(key("u", "url_key")), "day-keys")
        edges = materialise(self._key_edges(ids).unionByName(self._near_edges(keyed)).distinct(), "day-edges")

        # postings met on both sides, by the entities they have now
        today = keyed.select("seq")
        met = edges.select(F.explode(F.array("a", "b")).alias("seq")).distinct().join(today, "seq", "left_anti")
        met = materialise(met, "day-met")
        now = self.entities.lookup(met)
        now = now.join(self.names.lookup(now), "entity", "left").select("seq", F.coalesce("now", "entity").alias("entity"))
        now = materialise(now, "day-entities")
        of = lambda end: edges.join(now.withColumnRenamed("seq", end), end, "left").select(*[c for c in ("a", "b") if c != end], F.coalesce("entity", end).alias(end))
        ends = of("a").join(now.withColumnRenamed("seq", "b"), "b", "left").select("a", F.coalesce("entity", "b").alias("b"))
        root = materialise(components(ends.where("a <> b"), "day-components"), "day-roots")

        old = now.select(F.col("entity").alias("node")).distinct()
        known = root.join(old, "node", "left_semi").select("root").distinct().unionByName(old.select(F.col("node").alias("root"))).distinct()
        mine = today.join(root, today["seq"] == root["node"], "left").select("seq", F.coalesce("root", "seq").alias("entity"))
        mine = mine.join(known.select(F.col("root").alias("entity"), F.lit(True).alias("_known")), "entity", "left")
        mine = materialise(mine.select("seq", "entity", F.col("_known").isNull().alias("is_new")), "day-members")

        renamed = root.join(old, "node", "left_semi").where("node <> root").select(F.col("node").alias("entity"), F.col("root").alias("now"))
        renamed = materialise(renamed, "day-renamed")
        again = self.names.read().select(F.col("entity").alias("was"), F.col("now").alias("entity")).join(renamed, "entity").select(F.col("was").alias("entity"), "now")
        names = materialise(renamed.unionByName(again), "day-names")

        self.entities.merge(mine.select("seq", "entity"))
        self.names.merge(names)
        first = ids.groupBy("id").agg(F.min("seq").alias("seq"))
        self.keys.merge(materialise(first, "day-first"), lambda old, new, known: {"seq": F.coalesce(old("seq"), new("seq"))})
        nodes = keyed.groupBy("norm_company", F.array_sort("title_tokens").alias("title_tokens"), "sim").agg(F.min("seq").alias("seq")).where(F.size("title_tokens") > 0)
        nodes = nodes.select(F.xxhash64("norm_company", "title_tokens", "sim").alias("id"), "norm_company", "title_tokens", "sim", "seq")
        self.nodes.merge(materialise(nodes, "day-nodes"), lambda old, new, known: {"seq": F.coalesce(old("seq"), new("seq"))})
        return mine
