"""Phrase tables of any size against the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import fixed, parse
from millrace.operators import keywords, phrases
from millrace.operators.graph import materialise

LEX = {
    "python": ("tech", "G", None, ["Python", "python language"]), "node.js": ("tech", "G", None, ["Node.js", "nodejs"]), "c++": ("tech", "G", None, ["C++"]), ".net": ("tech", "G", None, [".NET"]),
    "test case": ("tech", "G", None, ["test case"]), "go": ("tech", "G", None, ["=Go"]), "ci/cd": ("tech", "G", None, ["CI/CD", "continuous integration"]), "bus": ("x", "G", None, ["bus"]), "box": ("x", "G", None, ["box"]),
}
WORDS = ["Python", "python", "languages", "language", "Node.js", "node js", "nodejs", "C++", "c", ".NET", "net", "test", "case", "cases", "Go", "go", "CI/CD", "ci / cd", "continuous", "integration", "bus", "buses", "boxes", "the", "and", "-", ",", "é"]


def lines(spark, n):
    rng = random.Random(n)
    return spark.createDataFrame([(i, i % 3, rng.choice([" ", ", ", "  "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))) for i in range(n)], "doc_id long, seg int, segment string")


@pytest.mark.parametrize("hot", [10_000, 5])
def test_hits_equal_those_of_small_lexicons(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT_ROWS", hot)
    segs, lex = lines(spark, 600), keywords.lexicon_table(spark, LEX)
    want = sorted(map(tuple, keywords.hits(segs, lex).collect()))
    assert sorted(map(tuple, phrases.hits(segs, lex).collect())) == want and len(want) > 500


def test_half_a_million_wordings(spark):
    """What is shuffled is what is found (and chance passes of the filter), not words times wordings."""
    many = spark.range(500_000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("word"), "id", F.lit(" thing"), F.col("id") % 1000).alias("alias"), F.lit(0).alias("rank"))
    many = many.withColumn("pattern", F.concat(F.lit("(?<![A-Za-z0-9+#])(?i:"), "alias", F.lit(r"(?:s|es)?)(?![A-Za-z0-9+#])")))
    segs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("seg"), F.concat(F.lit("we seek word"), F.col("id") * 50, F.lit(" thing"), F.col("id") * 50 % 1000, F.lit("s and much else of no concern to the index")).alias("segment"))
    aliases = materialise(phrases.with_hash(many, F.col("alias")), "aliases")
    assert len(phrases.filter_bits(aliases)) <= phrases.MOST_BITS // 8
    found = phrases.runs_found(segs, "segment", aliases, plural=True).count()
    got = phrases.hits(segs, many)
    assert got.count() == got.select("doc_id").distinct().count() == 10_000
    assert 10_000 <= found < 13_000


def test_places_equal_the_built_in_ones(spark):
    rng = random.Random(4)
    names = [*fixed.AREAS][:40]
    text = lambda: " ".join(rng.choice([*names, "house", "road", "near", "Remote", "Paris"]) for _ in range(rng.randint(0, 3)))
    rows = spark.createDataFrame([(i, rng.choice([text(), None, ""]), rng.choice([text(), None, "x " * 400 + names[0]])) for i in range(300)], "id long, location string, description string")
    places = spark.createDataFrame([(n, float(a[0]), float(a[1])) for n, a in fixed.AREAS.items()], "name string, lat double, lon double")
    got = {r["id"]: (r["area"], r["km"], r["remote"]) for r in phrases.resolve_places(rows, "id", places, fixed.HOME, fixed.REMOTE).collect()}
    plain = rows.select("id", parse.resolve_area(F.col("location"), F.col("description")).alias("p")).select("id", "p.area", "p.km", "p.remote")
    want = {r["id"]: (r["area"].replace("Dhaka (area not stated)", ""), r["km"], r["remote"]) for r in plain.collect()}
    same = {i for i in want if got[i] == want[i]}
    # names as long as each other: the first in order here, the first in the table there
    assert all(len(got[i][0]) == len(want[i][0]) for i in want.keys() - same) and len(same) > 200
    whole = phrases.resolve_places(rows, "id", places, fixed.HOME, fixed.REMOTE, opening=None)
    assert whole.where("area <> ''").count() > sum(a != "" for a, _, _ in got.values())


def test_nothing(spark):
    lex = keywords.lexicon_table(spark, LEX)
    assert phrases.hits(spark.createDataFrame([], "doc_id long, seg int, segment string"), lex).count() == 0
    assert phrases.hits(lines(spark, 10), lex.where("false")).count() == 0
