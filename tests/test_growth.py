"""Cases that show only on larger tables, made small."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import mining, phrases, places, search
from millrace.plans import composed
from millrace.sources import boards, landed

from .conftest import SF


def against_sql(spark, tables, name):
    """Rows of a query and of its SQL on the tables of a folder."""
    con = duckdb.connect()
    for t in tables.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}/*.parquet'")
    cols = sorted((df := entry.queries()[name](spark, str(tables))).columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, df.select(cols).collect())), sorted(map(repr, want)), cols


def test_chosen_with_part_numbers_of_seven_digits(spark, tmp_path):
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string"
    rows = [(1, 1_000_000 * (n % 3) + n, 1, n, 10.0, 0.0, "N", "O") for n in range(1, 6)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want, cols = against_sql(spark, tmp_path, "o9_15_chosen")
    assert cols == ["doc_id", "rank"] and len(want) == 2
    assert [g.replace("Row(doc_id=", "(").replace("rank=", "") for g in got] == want


def test_whole_detail_texts_are_not_broadcast(spark):
    postings = spark.createDataFrame([("https://b.example/1", "t", "short", "c", None, None, "")], "url string, title string, description string, category string, salaryMin int, salaryMax int, salaryText string")
    pages = spark.createDataFrame([("https://b.example/1", "<body><p>" + "long " * 5_000 + "</p><p>Tk 20,000</p></body>")] * 2, "url string, body string")
    more = boards.with_details(postings, pages, "div.job", most_chars=None)
    assert "Broadcast" not in more._jdf.queryExecution().executedPlan().toString()
    r = more.collect()
    assert len(r) == 1 and len(r[0]["description"]) > 24_000 and r[0]["salaryMin"] == 20_000


def test_parts_are_dealt_to_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1 and composed.parts(spark, SF).rdd.getNumPartitions() == n


def test_a_mail_is_read_once(spark):
    mail = "Subject: a\nContent-Type: text/html\n\n<p><a href='https://b.example/job/{0}'>Engineer {0}</a></p><p>Firm {0}</p><p>Banani, Dhaka</p>"
    mails = spark.createDataFrame([("box", mail.format(k).encode()) for k in "xy"], "path string, content binary")
    found = landed.mail_alerts(mails, F.lit("2026-10-10").cast("date"), "/job/")
    assert {(r["title"], r["company"]) for r in found.collect()} == {("Engineer x", "Firm x"), ("Engineer y", "Firm y")}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_crowded_cell_in_parts(spark, monkeypatch):
    monkeypatch.setattr(places, "MOST_IN_PART", 2)
    posts = spark.createDataFrame([(i, 89.0 + i / 100, i * 7.0 - 170) for i in range(50)] + [(99, 0.0, 0.0)], "seq long, lat double, lon double")
    homes = spark.createDataFrame([(1, 89.9, 10.0), (2, 0.1, 0.1), (3, -50.0, 3.0)], "home long, lat double, lon double")
    got = [(r["home"], r["seq"]) for r in places.within_km(posts, homes, 500).collect()]
    assert sorted(got) == [(1, i) for i in range(50)] + [(2, 99)]


def test_runs_of_long_texts_go_out_in_small_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "amber hill " * 3_000), (2, "blue lake amber hill"), (3, None)], "id long, t string")
    names = spark.createDataFrame([("amber hill",), ("hill amber",), ("blue lake",)], "name string")
    p = phrases.with_hash(names, F.col("name"))
    monkeypatch.setattr(phrases, "MOST_BYTES", 1_000)
    got = phrases.runs_found(rows, "t", p)
    assert sorted(r["id"] for r in got.select("id").collect()) == [1, 1, 2, 2]
    assert list(phrases._cuts(phrases.np.array([600, 600, 5_000, 10, 20]), 1_000)) == [(0, 1), (1, 2), (2, 3), (3, 5)]


def test_trigrams_of_many_texts_are_listed_some_at_a_time(monkeypatch):
    texts = [b"some words and some more words " * 9, b"", b"ab", b"other words", b"xyz"]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([5, 1 << 17, 7, 8, 9]), "t": pa.array(texts, pa.binary())})
    places_of = lambda out: sorted((r["trigram"], r["block"], i) for b in out for r in b.to_pylist() for i in r["ids"])
    whole = list(search.lists(iter([batch])))
    assert len(whole) == 1 and len(places_of(whole)) == sum(len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts)
    monkeypatch.setattr(search, "MOST_HELD", 6)
    monkeypatch.setattr(search, "PIECE", 4)
    parts = list(search.lists(iter([batch])))
    assert len(parts) == 3 and places_of(parts) == places_of(whole)


def test_terms_are_made_once(spark):
    rows = [(1, "solar panel", 2), (1, "panel", 2), (1, "solar", 3), (None, "wind farm", 2), (None, "farm", 2)]
    row = "named_struct('doc_id', d, 'key', k, 'name', k, 'count', n, 'score', 1L, 'ord', 0, 'words', size(split(k, ' ')), 'shape', true, 'pointed_at', true)"
    terms = spark.createDataFrame(rows, "d long, k string, n long").selectExpr(f"{row} AS r").select("r.*")
    kept = mining.accepted(terms)
    assert {(r["doc_id"], r["key"]) for r in kept.collect()} == {(1, "solar panel"), (1, "solar"), (None, "wind farm"), (None, "farm")}
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
