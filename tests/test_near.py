"""Close titles and near signatures against all pairs, and with one title for everybody."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedupe, near
from millrace.operators.graph import components

SETS = "c string, node long, tokens array<string>"


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [None, 3, 17])
@pytest.mark.parametrize("threshold", [0.5, 0.72, 0.9])
def test_linked_sets_against_all_pairs(spark, block, threshold):
    rng = random.Random(int(threshold * 100))
    words = [f"w{i}" for i in range(14)]
    rows = {(rng.choice("xy"), tuple(sorted(rng.sample(words, rng.randint(1, 9))))) for _ in range(260)}
    rows = [(c, i, list(t)) for i, (c, t) in enumerate(sorted(rows))]
    want = [(p[1], q[1]) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and len(set(p[2]) & set(q[2])) / len(set(p[2]) | set(q[2])) >= threshold]
    got = [tuple(r) for r in near.linked_sets(spark.createDataFrame(rows, SETS), ["c"], threshold, block).collect()]
    nodes = [r[1] for r in rows]
    assert roots(nodes, got) == roots(nodes, want)  # a forest's edge need not be a link


@pytest.mark.parametrize("block", [None, 3, 40])
def test_close_pairs_once_each(spark, monkeypatch, block):
    monkeypatch.setattr(near, "MOST_TOKENS", 50)
    rng = random.Random(5)
    rows = {(rng.choice(["x", "y", None]), tuple(sorted(rng.sample([f"w{i}" for i in range(14)], rng.randint(1, 9))))) for _ in range(260)}
    rows = [(c, i, list(t)) for i, (c, t) in enumerate(sorted(rows, key=repr))]
    j = lambda p, q: len(set(p[2]) & set(q[2])) / len(set(p[2]) | set(q[2]))
    want = [(p[1], q[1], j(p, q)) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and j(p, q) >= 0.5]
    got = near.close_pairs(spark.createDataFrame(rows, SETS).withColumn("c", F.coalesce("c", F.lit("z"))), ["c"], 0.5, block)
    assert sorted(map(tuple, got.collect())) == want
    titles = spark.createDataFrame(rows, SETS).toDF("norm_company", "seq", "tokens")
    edges = dedupe.title_edges(titles, 0.5)
    assert sorted(map(tuple, edges.collect())) == [w for w in want if rows[w[0]][0]]
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()  # pairs are not shuffled


def test_tokens_that_no_other_has_are_no_keys(spark):
    rows = [("x", i, ["common", f"lone{i}", f"own{i}"]) for i in range(5)] + [("y", 9, ["common", "lone1"])]
    assert near.filed(spark.createDataFrame(rows, SETS), ["c"], 0.5).count() == 0
    assert near.filed(spark.createDataFrame([*rows, ("y", 10, ["lone1"])], SETS), ["c"], 0.5).count() == 2


def test_sets_of_many_tokens_are_counted_by_strips(spark, monkeypatch):
    monkeypatch.setattr(near, "STRIP", 7)
    rows = [("x", i, [f"t{j}" for j in range(i, 60 + i)]) for i in range(0, 60, 5)]
    got = [tuple(r) for r in near.linked_sets(spark.createDataFrame(rows, SETS), ["c"], 0.8).collect()]
    want = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])) >= 0.8]
    assert want and roots([r[1] for r in rows], got) == roots([r[1] for r in rows], want)


def postings(spark, n, title):
    return spark.range(n).select(F.col("id").alias("seq"), F.lit("unknown").alias("norm_company"), title.alias("title_tokens"), F.xxhash64("id").alias("sim"))


def test_one_title_for_everybody_gives_fewer_edges_than_rows(spark):
    keyed = postings(spark, 100_000, F.array(F.lit("test"), F.lit("engineer")))
    edges = dedupe.near_edges(keyed)
    assert edges.count() < 100_000
    assert components(edges).select("root").distinct().count() == 1


def test_close_titles_of_one_company_give_a_forest(spark):
    """5,000 titles that are all close to each other: 12.5 million pairs, few edges."""
    base = [F.lit(w) for w in "lead senior test software quality engineer remote dhaka".split()]
    keyed = postings(spark, 5_000, F.array(*base, F.concat(F.lit("t"), F.col("id"))))
    edges = dedupe.title_links(dedupe.title_nodes(keyed))
    blocks = -(-5_000 // near.BLOCK)
    assert edges.count() < 5_000 * (blocks + 1) * 3
    assert components(edges).select("root").distinct().count() == 1


def test_empty(spark):
    assert near.linked_sets(spark.createDataFrame([], SETS), ["c"], 0.7).count() == 0
    assert near.linked(spark.createDataFrame([], "g string, node long, sig long"), ["g"], 6).count() == 0
