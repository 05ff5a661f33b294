"""A run from landed files to a notice."""

import json

from pyspark.sql import functions as F

from millrace.operators import scoring
from millrace.plans import runs
from millrace.sources import fanin, landed

LEDGER = "fingerprint string, first_seen string, status string, notified boolean, last_seen string"


def test_config_and_env():
    assert runs.merged({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "e": 3}) == {"a": {"b": 1, "c": [2]}, "d": 2, "e": 3}
    env = {"A": "1"}
    assert runs.read_env(["# no", "A=2", 'B="x y"', "bad"], env) == 1 and env == {"A": "1", "B": "x y"}


def test_discover(spark, tmp_path):
    items = [
        {"title": "SQA Engineer", "company": "Brindlework IT Ltd.", "location": "Banani, Dhaka", "url": "https://a.example/1?utm_source=x", "source": "A", "salary": "Tk 30,000", "description": "We test web systems with Selenium every day"},
        {"title": "Software Quality Assurance Engineer", "company": "Brindlework Limited", "location": "Banani", "url": "https://b.example/2", "source": "B", "description": "We test web systems with Selenium every single day and write reports"},
        {"title": "Cook", "company": "Cafe", "location": "London, UK", "url": "https://c.example/3", "source": "A"},
    ]
    (tmp_path / "x.json").write_text(json.dumps({"jobs": items}))
    day = F.lit("2026-10-10").cast("date")
    postings, report = fanin.collect(spark, {"local": True}, {"local": lambda own, queries: (landed.local_json(spark, str(tmp_path), day), None, [])}, [])
    postings = postings.withColumn("seq", F.xxhash64("url"))
    profile = scoring.Profile(titles=["SQA Engineer"], skills=["Selenium"], categories=["Software Quality Assurance"], minimum=30, strong=60, years=0)
    run = runs.discover(postings, postings.where("false"), spark.createDataFrame([], LEDGER), profile, day)
    feed = {r["company"].split()[0]: r for r in run.feed.collect()}
    assert set(feed) == {"Brindlework", "Cafe"} and feed["Brindlework"]["source"] == "A + B" and feed["Brindlework"]["salaryMin"] == 30000
    assert feed["Brindlework"]["priority"] == "A" and feed["Cafe"]["priority"] == "C"
    c = run.counts.first()
    assert (c["total"], c["A"], c["C"], c["new"], c["folded"]) == (2, 1, 1, 2, 1)
    assert [r["company"].split()[0] for r in run.notice.collect()] == ["Brindlework"] and run.ledger.count() == 2 and report.first()["found"] == 3
    assert {r["priority"]: r["n"] for r in runs.statistics(run.feed).collect()} == {"A": 1, "C": 1}


def test_alerts(spark):
    h = spark.createDataFrame([("s", i, 0, 1, None) for i in range(1, 5)] + [("t", 1, 3, 0, 3)], "source string, run int, found int, n_errors int, raw int")
    assert [tuple(r) for r in runs.alerts(h).collect()] == [("s", 4)]
