"""Retention and health as state with timers, and the outbox, against batch forms."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import state
from millrace.sources import notices
from millrace.sources.buckets import BucketTable
from millrace.streaming import retention

POSTINGS = "fingerprint string, at timestamp, createdAt string, deadline string, status string"
DECISIONS = "fingerprint string, at timestamp, status string"
DAY0 = datetime(2026, 3, 1)


def run(spark, tmp_path, streams, build, name):
    """Feed each day's rows as a micro-batch; changes so far and the progress of each batch."""
    folders = [tmp_path / f"{name}-{i}" for i in range(len(streams))]
    for f in folders:
        f.mkdir()
    sources = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(f)) for f, (schema, _) in zip(folders, streams, strict=True)]
    with retention.timed_state(spark):
        q = build(*sources).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
        sizes = []
        for day in range(max(len(d) for _, d in streams)):
            for f, (_, days) in zip(folders, streams, strict=True):
                (f / f".{day}.json").write_text("\n".join(json.dumps(r) for r in days[day]))
                (f / f".{day}.json").rename(f / f"{day}.json")
            q.processAllAvailable()
            if q.lastProgress:
                sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        q.stop()
    return spark.table(name), sizes


def test_retention_equals_batch(spark, tmp_path):
    posts, decided = [], []
    for day in range(12):
        at = (DAY0 + timedelta(day)).isoformat()
        created = (DAY0 + timedelta(day)).date()
        new = [{"fingerprint": f"{day}-{k}", "at": at, "createdAt": created.isoformat(), "deadline": [None, (created + timedelta(2)).isoformat(), "soon"][k % 3], "status": "Awaiting Review"} for k in range(6)]
        again = [{**r, "at": at, "status": "Awaiting Review"} for r in (posts[-1][:2] if posts else [])]
        posts.append(new + again)
        # a day later: one is taken up, one that was is given up, one nobody knows
        decided.append([{"fingerprint": f"{day - 1}-3", "at": at, "status": "Applied"}, {"fingerprint": f"{day - 3}-3", "at": at, "status": "Rejected" if day % 2 else "Applied"}, {"fingerprint": "nobody", "at": at, "status": "Applied"}])
    changes, sizes = run(spark, tmp_path, [(POSTINGS, posts), (DECISIONS, decided)], lambda p, d: retention.retention_stream(p, d, days=4), "kept")
    rows = changes.collect()
    gone = {r["fingerprint"] for r in rows if r["change"] == "expired"}
    live = {r["fingerprint"] for r in rows} - gone
    status = {}
    for day in range(12):
        for r in posts[day]:
            status.setdefault(r["fingerprint"], r)
        for r in decided[day]:
            if r["fingerprint"] in status:
                status[r["fingerprint"]] = {**status[r["fingerprint"]], "status": r["status"]}
    end = (DAY0 + timedelta(11)).date().isoformat()
    feed = spark.createDataFrame([(k, v["createdAt"], v["deadline"], v["status"]) for k, v in status.items()], "fingerprint string, createdAt string, deadline string, status string")
    want = {r[0] for r in feed.where(state.still_relevant(F.lit(end).cast("date"), 4)).select("fingerprint").collect()}
    assert live == want and len(gone) > 30 and any(status[k]["status"] == "Applied" for k in live)
    assert sizes[-1] < len(status) and max(sizes) <= 4 * len(want)  # state goes with the postings
    assert all(r["day"] for r in rows if r["change"] == "expired")


def test_health_forgets_absent_sources(spark, tmp_path):
    schema = "source string, run long, found long, n_errors long, raw long, at timestamp"
    day = lambda d, s, found: {"source": s, "run": d, "found": found, "n_errors": 1 - found, "raw": None, "at": (DAY0 + timedelta(d)).isoformat()}
    days = [[day(d, "steady", 1)] + ([day(d, "silent", 0)] if d in (0, 1, 8, 9, 10) else []) for d in range(12)]
    changes, sizes = run(spark, tmp_path, [(schema, days)], lambda r: retention.health_stream(r, 3, timedelta(days=3)), "health")
    got = {r["run"]: (r["streak"], r["alert"]) for r in changes.where("source = 'silent'").collect()}
    # its streak of two is forgotten before it comes back
    assert got == {0: (1, False), 1: (2, False), 8: (1, False), 9: (2, False), 10: (3, True)}
    assert min(sizes[4:8]) < max(sizes[:2])


def picks(spark, n, fail=False):
    bad = F.when(F.col("id") == n - 1, F.raise_error(F.lit("lost"))).otherwise(F.lit("t")) if fail else F.lit("t")
    return spark.range(n).repartition(3).select(F.concat(F.lit("f"), "id").alias("fingerprint"), bad.cast("string").alias("title"))


def test_a_failed_notice_marks_nothing_and_a_retry_sends_once(spark, tmp_path):
    ledger = BucketTable(spark, str(tmp_path / "ledger"), "fingerprint", state.LEDGER, 4)
    state.upsert_ledger(ledger, spark.range(30).selectExpr("concat('f', id) fingerprint", "'2026-01-01' createdAt", "'Awaiting Review' status"), F.lit("2026-01-02").cast("date"))
    told = lambda: {r["fingerprint"] for r in ledger.read().where("notified").collect()}
    box = str(tmp_path / "outbox")
    with pytest.raises(Exception, match="lost"):
        notices.notify(picks(spark, 20, fail=True), box, 1, ledger)
    assert told() == set() and notices.receipts(spark, box).count() == 0
    notices.notify(picks(spark, 20), box, 1, ledger)
    assert told() == {f"f{i}" for i in range(20)} and notices.receipts(spark, box).count() == 20
    notices.notify(picks(spark, 20), box, 1, ledger)  # the run is tried again after its commit
    notices.Outbox(box).sweep()  # what died tasks left
    assert notices.receipts(spark, box).count() == 20 and len(list((tmp_path / "outbox" / "parts").iterdir())) == len(notices.Outbox(box).committed())
    notices.notify(picks(spark, 0), box, 2, ledger)
    assert notices.receipts(spark, box, since=2).count() == 0
    assert state.notice_picks(spark.createDataFrame([("a", "B", 1)], "fingerprint string, priority string, matchScore int"), spark.createDataFrame([], "fingerprint string"), "A").count() == 0


def test_outbox_of_a_stream(spark, tmp_path):
    notices.register(spark)
    src, box = tmp_path / "in", str(tmp_path / "outbox")
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"fingerprint": f"{k}-{i}"}) for i in range(450)))
    for _ in range(2):  # started again, it has nothing to say
        stream = spark.readStream.schema("fingerprint string").option("maxFilesPerTrigger", 1).json(str(src))
        q = stream.writeStream.format("notices").option("path", box).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [r[0] for r in notices.receipts(spark, box).collect()]
    assert len(got) == len(set(got)) == 1350
    lines = [len(p.read_text().splitlines()) for p in (tmp_path / "outbox" / "parts").iterdir()]
    assert max(lines) <= notices.ROWS


def test_forced_notice_falls_back_to_the_best(spark):
    feed = spark.createDataFrame([(f"f{i}", "A" if i < 8 else "B", i) for i in range(12)], "fingerprint string, priority string, matchScore int")
    none = spark.createDataFrame([], "fingerprint string")
    new = spark.createDataFrame([("f1",), ("f9",)], "fingerprint string")
    take = lambda *a, **k: [r["fingerprint"] for r in state.notice_picks(*a, **k).collect()]
    assert take(feed, new, "A") == ["f1"] and take(feed, new, "A", force=True) == ["f1"]
    assert take(feed, none, "A") == [] and sorted(take(feed, none, "A", force=True)) == [f"f{i}" for i in range(3, 8)]


def test_many_postings_share_a_state(spark, tmp_path):
    """3,000 postings in 8 buckets: so many states and timers, not so many as postings; each leaves on its own day."""
    day = lambda n: (DAY0 + timedelta(n)).date().isoformat()
    post = lambda i, d, **k: {"fingerprint": f"p{i}", "at": (DAY0 + timedelta(d)).isoformat(), "createdAt": day(d), "deadline": day(d + i % 3) if i % 2 else None, "status": "Applied" if i % 10 == 0 else "Awaiting Review"} | k
    posts = [[post(i, 0) for i in range(3000)], [post(7, 1, deadline=day(9), createdAt=day(1)), {**post(1, 1), "fingerprint": None}], [post(3000, 2)], [post(3001, 4)], [post(3002, 6)]]
    decided = [[{"fingerprint": "p8", "at": (DAY0 + timedelta(0)).isoformat(), "status": "Applied"}], *[[{"fingerprint": "p20", "at": (DAY0 + timedelta(d)).isoformat(), "status": "Rejected"}] for d in (1, 2, 3, 4)]]
    build = lambda p, d: retention.retention_stream(p, d, days=4, buckets=8)
    changes, sizes = run(spark, tmp_path, [(POSTINGS, posts), (DECISIONS, decided)], build, "shared")
    assert max(sizes) <= 8 * 4  # a state and a timer (held both ways) of each
    rows = changes.where("change = 'expired'").collect()
    gone = {r["fingerprint"]: r["day"] for r in rows}
    assert len(gone) == len(rows)
    want = {None: day(3)} | {f"p{i}": day(min(4, i % 3) + 1 if i % 2 else 5) for i in range(3000) if i % 10 and i not in (7, 8)} | {"p7": day(5), "p20": day(5)}
    assert {n: d for n, d in gone.items() if n not in ("p3000", "p3001", "p3002")} == want
    with pytest.raises(Exception, match="8 buckets, not 9"):
        source = [spark.readStream.schema(s).json(str(tmp_path / f"shared-{i}")) for i, s in enumerate((POSTINGS, DECISIONS))]
        (tmp_path / "shared-0" / "9.json").write_text("\n".join(json.dumps(post(i, 7)) for i in range(10, 3000, 10)))
        with retention.timed_state(spark):
            q = retention.retention_stream(*source, days=4, buckets=9).writeStream.format("parquet").option("path", str(tmp_path / "none")).option("checkpointLocation", str(tmp_path / "shared-cp")).trigger(availableNow=True).start()
            q.awaitTermination()
