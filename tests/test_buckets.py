"""Bucket tables, and entities kept up day by day, against whole runs."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedupe, resolution
from millrace.plans.catalogue import document_postings
from millrace.sources.buckets import BucketTable

from .conftest import SF

LEDGER = "fingerprint string, status string, seen int"


def files(root):
    return {str(p.relative_to(root)) for p in (root / "data").rglob("part-*")}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), "fingerprint", LEDGER, 16)
    assert t.read().count() == 0 and t.merge(spark.createDataFrame([], LEDGER)) == 0
    t.merge(spark.range(500).selectExpr("concat('f', id) fingerprint", "'new' status", "cast(id as int) seen"))
    before, folders = files(tmp_path), t.manifest()[1]
    t.merge(spark.createDataFrame([("f7", None, 9), ("fresh", "x", 1)], LEDGER), lambda old, new, known: {"seen": F.greatest(old("seen"), new("seen"))})
    after = t.manifest()[1]
    changed = {b for b in after if after[b] != folders[b]}
    assert 1 <= len(changed) <= 2 and before <= files(tmp_path)
    got = {r["fingerprint"]: (r["status"], r["seen"]) for r in t.read().collect()}
    assert len(got) == 501 and got["f7"] == ("new", 9) and got["f8"] == ("new", 8) and got["fresh"] == ("x", 1)
    assert t.read(1).count() == 500  # the version before
    t.merge(spark.createDataFrame([("f8", "seen", 8), ("nobody", "x", 1)], LEDGER), insert=False)
    assert t.read().count() == 501 and t.lookup(spark.createDataFrame([("f8",), ("nobody",)], "fingerprint string")).collect()[0]["status"] == "seen"
    t.vacuum()
    assert t.read().count() == 501 and t.versions() == [3]


def test_of_two_merges_from_one_state_one_fails(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), "fingerprint", LEDGER, 4)
    t.merge(spark.createDataFrame([("a", "x", 1)], LEDGER))
    rows = spark.createDataFrame([("a", "y", 2)], LEDGER)
    late = BucketTable(spark, str(tmp_path), "fingerprint", LEDGER, 4)
    stale = late.manifest()
    late.manifest = lambda version=None: stale
    t.merge(rows)
    with pytest.raises(RuntimeError):
        late.merge(rows)
    assert [r["status"] for r in t.read().collect()] == ["y"]


def postings(spark):
    p = document_postings(spark, SF)
    # companies of few, so that many titles and texts meet; some urls and titles said again
    company = F.concat(F.lit("c"), F.col("seq") % 7)
    p = p.withColumn("company", company).withColumn("title", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("quality engineer team "), F.col("seq") % 5)).otherwise(F.substring("title", 1, 40)))
    return p.withColumn("url", F.when(F.col("seq") % 11 == 0, F.concat(F.lit("https://x.example/"), F.col("seq") % 4)).otherwise(F.col("url")))


@pytest.mark.parametrize("days", [3])
def test_days_equal_one_run(spark, tmp_path, days):
    p = postings(spark).cache()
    whole = {r["seq"]: r["group_id"] for r in dedupe.groups(dedupe.canonical(p)).collect()}
    store, announced = resolution.EntityStore(spark, str(tmp_path), 4), set()
    for day in range(days):
        got = store.add(p.where((F.col("seq") * 7919) % days == day)).collect()
        announced |= {r["entity"] for r in got if r["is_new"]}
    assert {r["seq"]: r["entity"] for r in store.members().collect()} == whole
    assert len(set(whole.values())) < 0.7 * len(whole) and set(whole.values()) <= announced | set(whole)


def test_a_survivors_new_fingerprint_is_not_news(spark, tmp_path):
    from .test_operators import post, rows

    store = resolution.EntityStore(spark, str(tmp_path), 4)
    one = store.add(rows(spark, [post(1, "SQA Engineer", "Acme", "https://a.example/1", "short")])).collect()
    # the same url under another title and area, with a longer text: it will be the survivor
    two = store.add(rows(spark, [post(2, "Tester of webshops", "Acme", "https://a.example/1", "a longer text of many words", area="Banani"), post(3, "Cook", "Other", "https://b.example/1", "")])).collect()
    assert [(r["entity"], r["is_new"]) for r in one] == [(1, True)]
    assert {r["seq"]: (r["entity"], r["is_new"]) for r in two} == {2: (1, False), 3: (3, True)}
    # a posting that links two entities: the first name stays, nothing is new
    three = store.add(rows(spark, [post(4, "Cook", "Other", "https://a.example/1", "")])).collect()
    assert [(r["entity"], r["is_new"]) for r in three] == [(1, False)]
    assert {r["seq"]: r["entity"] for r in store.members().collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    again = store.add(rows(spark, [post(4, "Cook", "Other", "https://a.example/1", "")])).collect()
    assert [r["is_new"] for r in again] == [False] and store.members().count() == 4
