"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from millrace.operators import state
from millrace.plans.catalogue import event_runs
from millrace.streaming import incremental

from .conftest import SF


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_health_by_state_equals_windows(spark, tmp_path):
    runs = event_runs(spark, SF).where("source < '3'")
    runs.repartition(1).sortWithinPartitions("run").write.parquet(str(tmp_path / "runs"))
    batch = state.health(runs, threshold=2).select("source", "run", "streak", "alert")
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    got = drain(incremental.health_stream(stream, threshold=2), "health", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_first_seen_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    for k, keys in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(x,) for x in keys], "fingerprint string").coalesce(1).write.mode("append").parquet(str(src))
        got = drain(incremental.first_seen(spark.readStream.schema("fingerprint string").parquet(str(src)), "fingerprint"), f"seen{k}", tmp_path)
    assert sorted(r[0] for r in got.collect()) == ["a", "b", "c"]


def test_feed_writer(spark):
    cols = "fingerprint string, id string, status string, createdAt string, deadline string"
    led = "fingerprint string, first_seen string, status string, notified boolean, last_seen string"
    out = []
    write = incremental.feed_writer(lambda: (spark.createDataFrame([], cols), spark.createDataFrame([], led)), lambda *a: out.append((a[0].count(), a[2].count(), a[3])), lambda: F.lit("2026-10-10").cast("date"))
    write(spark.createDataFrame([("a", "1", "Saved", "2026-10-09", None)], cols), 7)
    assert out == [(1, 1, 7)]
