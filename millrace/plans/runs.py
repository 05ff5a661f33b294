"""Whole runs: landed payloads in, a merged and scored feed, ledger, counts and alerts out."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import dedupe, scoring, state
from ..operators.graph import materialise
from ..sources import landed

#: What a configuration may leave out.
DEFAULTS: dict[str, Any] = {"filters": {"min_salary": 20_000, "max_km": 10, "allow_abroad": False}, "retention_days": fixed.RETENTION_DAYS, "drop_expired": True, "notify": {"at_least": "B"}, "health_threshold": fixed.HEALTH_THRESHOLD}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` laid on ``base``, mapping by mapping; lists and values replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def read_env(lines: list[str], env: dict[str, str] | None = None) -> int:
    """Set ``NAME=value`` lines that are not set yet; how many were."""
    env = os.environ if env is None else env
    n = 0
    for line in lines:
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#") and name.strip() not in env:
            env[name.strip()] = value.strip().strip("\"'")
            n += 1
    return n


@dataclass
class Run:
    feed: DataFrame
    ledger: DataFrame
    new: DataFrame
    counts: DataFrame
    report: DataFrame
    notice: DataFrame


def discover(postings: DataFrame, previous: DataFrame, ledger: DataFrame, profile: scoring.Profile, as_of: Column, config: Mapping[str, Any] | None = None) -> Run:
    """Enrich, deduplicate, score, merge with what is remembered, and choose what to announce.

    ``postings`` have the schema of ``sources.landed`` and a distinct ``seq``.  Two tables are
    written on the way (canonical postings and groups), the rest is one plan for each output.
    """
    cfg = merged(DEFAULTS, config or {})
    report = postings.groupBy("discoveredBy").agg(F.count("*").alias("found"))
    unique = dedupe.deduplicate(landed.enrich(postings))
    scored = scoring.score_postings(unique, profile, **cfg["filters"])
    # two groups can share a fingerprint only by quirks of filled areas: the first stays
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("group_id"))
    scored = materialise(scored.withColumn("_n", first).where("_n = 1").drop("_n"), "scored")
    feed, after, new = state.merge_feed(scored, previous, ledger, as_of, cfg["retention_days"], cfg["drop_expired"])
    every, _, _ = state.merge_feed(scored, previous, ledger, as_of, cfg["retention_days"], False)
    expired = every.join(feed.select("fingerprint"), "fingerprint", "left_anti").agg(F.count("*").alias("expired"))
    counts = state.run_counts(feed).crossJoin(expired).crossJoin(new.agg(F.count("*").alias("new"))).crossJoin(scored.agg(F.sum(F.col("n_merged") - 1).alias("folded")))  # one row each
    return Run(feed, after, new, counts, report, state.select_for_notice(feed, new, cfg["notify"]["at_least"]))


def alerts(history: DataFrame, threshold: int = fixed.HEALTH_THRESHOLD) -> DataFrame:
    """Sources whose streak of failed runs reaches the threshold in their latest run."""
    h = state.health(history, threshold)
    last = h.withColumn("_last", F.max("run").over(Window.partitionBy("source")))
    return last.where("alert AND run = _last").select("source", "streak")


def statistics(feed: DataFrame, n: int = 5) -> DataFrame:
    """Rows of each priority and their first ``n`` lines."""
    top = state.top_rows(feed, n).withColumn("line", state.summary_line())
    lines = top.groupBy("priority").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))  # n lines
    return feed.groupBy("priority").agg(F.count("*").alias("n")).join(lines, "priority")
