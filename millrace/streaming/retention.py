"""What a feed keeps, as state with timers: postings leave it when they grow too old or their
deadline passes, unless somebody works on them.

A posting's state is its date of first sight, deadline, status and the first day it is no longer
relevant; postings and decisions move that day, active statuses take it away, and when it comes the
posting's state is gone.  Time is the events' own, by the watermark.

Postings lie in buckets by the hash of their fingerprint.  A bucket is one state with one timer, at the
first day that one of its postings leaves, as a call of the state store costs far more than a
posting: so many rows share the few calls of their bucket.  What a batch touches is read and written
by bucket, so there should be about ``PER_BUCKET`` postings in each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import fixed

#: Postings of a bucket, a column a list; ``leaves``: milliseconds, null while it is worked on.
STATE = "buckets int, fingerprint array<string>, created array<string>, deadline array<string>, status array<string>, leaves array<bigint>"
CHANGES = "fingerprint string, change string, status string, day string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Postings a bucket should hold, and buckets where the caller names no number.
PER_BUCKET, BUCKETS = 1_000, 4_096


@contextmanager
def timed_state(spark: SparkSession):
    """Streams started within keep state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat((text or "")[:10])
    except ValueError:
        return None


def _millis(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


def last_day(created: str | None, deadline: str | None, status: str | None, days: int) -> date | None:
    """The last day a posting is relevant; None: as long as it is active."""
    if status in fixed.ACTIVE_STATUSES:
        return None
    young, by = _day(created), _day(deadline)
    until = young + timedelta(days) if young else date.min
    return min(until, by) if by else until


class _Timed(StatefulProcessor):
    """State with one timer, by event time."""

    def __init__(self, schema: str) -> None:
        self.schema = schema

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def move_timer(self, before: int | None, at: int | None) -> None:
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


@lru_cache(100_000)
def _leaves(created: str | None, deadline: str | None, status: str | None, days: int) -> int | None:
    last = last_day(created, deadline, status, days)
    return None if last is None else _millis(max(last, date(1970, 1, 1)) + timedelta(1))


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["fingerprint", "change", "status", "day"], dtype=object)


class Retention(StatefulProcessor):
    """Buckets of postings, each a state with one timer, by event time."""

    def __init__(self, days: int, buckets: int) -> None:
        self.days, self.buckets = days, buckets

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def _load(self) -> dict:
        """fingerprint -> (created, deadline, status, leaves)"""
        buckets, *columns = self.state.get() or (self.buckets, [], [], [], [], [])
        if buckets != self.buckets:
            raise ValueError(f"the state was kept in {buckets} buckets, not {self.buckets}")
        names, *values = columns
        return dict(zip(names, zip(*values, strict=True), strict=True))

    def _keep(self, kept: dict, before: int | None) -> None:
        if kept:
            self.state.update((self.buckets, list(kept), *map(list, zip(*kept.values(), strict=True))))
        else:
            self.state.clear()
        at = self._first(kept)
        if before != at and before is not None:
            self.handle.deleteTimer(before)
        if before != at and at is not None:
            self.handle.registerTimer(at)

    def _first(self, kept: dict) -> int | None:
        return min((k[3] for k in kept.values() if k[3] is not None), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        # of a fingerprint's rows: its first posting, its last one, its last decision
        first, last, decided = {}, {}, {}
        for some in rows:
            for name, at, kind, created, deadline, status in zip(*(some[c] for c in ("fingerprint", "micros", "kind", "createdAt", "deadline", "status")), strict=True):
                if kind == "decision":
                    if name not in decided or decided[name][0] <= at:
                        decided[name] = (at, status)
                    continue
                if name not in first or at < first[name][0]:
                    first[name] = (at, created, status)
                if name not in last or last[name][0] <= at:
                    last[name] = (at, deadline)
        kept = self._load()
        before, out = self._first(kept), []
        for name in first.keys() | decided.keys():
            old = kept.get(name)
            if old is None and name not in first:  # decisions on what nobody has seen
                continue
            # a status that was decided stays; dates of the first sight stay
            seen, created, status = (None, old[0], old[2]) if old else first[name]
            deadline = last[name][1] if name in last else old[1]
            if name in decided and (old or decided[name][0] >= seen):
                status = decided[name][1]
            kept[name] = (created, deadline, status, _leaves(created, deadline, status, self.days))
            out.append((name, "kept", status, None))
        if out:
            self._keep(kept, before)
            yield _changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, now, out = self._load(), timerValues.getCurrentWatermarkInMs(), []
        for name, (_, _, status, at) in list(kept.items()):
            if at is not None and at <= now:
                del kept[name]
                out.append((name, "expired", status, datetime.fromtimestamp(at / 1000, timezone.utc).date().isoformat()))
        self._keep(kept, None)  # the timer that fired goes by itself
        if out:
            yield _changes(out)

    def close(self) -> None:
        pass


def retention_stream(postings: DataFrame, decisions: DataFrame | None = None, days: int = fixed.RETENTION_DAYS, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(fingerprint, at, createdAt, deadline, status) and decisions (fingerprint, at, status), as streams ->
    changes (fingerprint, change, status, day): "kept" with the status after each batch that touched a
    posting, "expired" with the first day it is irrelevant.

    ``createdAt`` is the date the ledger holds, which never forgets: a posting that comes again
    after it has expired expires again.  ``buckets`` holds for the life of a checkpoint; a stream started
    again with another number is refused.  Start it within :func:`timed_state`.
    """
    p = postings.select("fingerprint", "at", F.lit("posting").alias("kind"), "createdAt", F.col("deadline").cast("string").alias("deadline"), "status")
    if decisions is not None:
        none = F.lit(None).cast("string")
        p = p.unionByName(decisions.select("fingerprint", "at", F.lit("decision").alias("kind"), none.alias("createdAt"), none.alias("deadline"), "status"))
    p = p.withColumns({"bucket": F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int"), "micros": F.coalesce(F.unix_micros("at"), F.lit(-(1 << 62)))})
    return p.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(Retention(days, buckets), CHANGES, "append", "EventTime")


class Health(_Timed):
    def __init__(self, threshold: int, forget_ms: int) -> None:
        super().__init__("streak bigint, alerted boolean, timer bigint")
        self.threshold, self.forget_ms = threshold, forget_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        streak, alerted, timer = self.state.get() if self.state.exists() else (0, False, None)
        last = 0
        for r in sorted(rows, key=lambda r: r.run):
            bad = (r.found or 0) <= 0 and ((r.n_errors or 0) > 0 or (r.raw is not None and r.raw == 0))
            streak = streak + 1 if bad else 0
            fires = bad and streak >= self.threshold and not alerted
            alerted = bad and (alerted or fires)
            last = max(last, int(r.at.replace(tzinfo=timezone.utc).timestamp() * 1000))
            yield Row(source=key[0], run=r.run, streak=streak, alert=fires)
        at = max(last + self.forget_ms, timer or 0)
        self.move_timer(timer, at)
        self.state.update((streak, alerted, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        yield from ()


def health_stream(runs: DataFrame, threshold: int = fixed.HEALTH_THRESHOLD, forget: timedelta = timedelta(days=7), late: str = "0 seconds") -> DataFrame:
    """As :func:`..streaming.incremental.health_stream`, for runs with a time ``at``: a source that no run
    names for ``forget`` is forgotten, streak, alert and state."""
    out = "source string, run bigint, streak bigint, alert boolean"
    return runs.withWatermark("at", late).groupBy("source").transformWithState(Health(threshold, int(forget.total_seconds() * 1000)), out, "append", "EventTime")
