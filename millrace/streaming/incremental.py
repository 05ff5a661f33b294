"""Streaming forms of what is remembered between runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.state import merge_feed


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """Each key announced once, ever: state holds keys only, as a ledger never forgets."""
    return stream.dropDuplicates([key])


def health_stream(runs: DataFrame, threshold: int = fixed.HEALTH_THRESHOLD) -> DataFrame:
    """(source, run, found, n_errors, raw) -> (source, run, streak, alert) by state for each source.

    The state is two numbers; runs of a source within a micro-batch are taken in order.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, alerted = state.get if state.exists else (0, False)
        rows = []
        for r in pd.concat(list(parts)).sort_values("run").itertuples():
            found = 0 if pd.isna(r.found) else r.found
            bad = found <= 0 and ((not pd.isna(r.n_errors) and r.n_errors > 0) or (not pd.isna(r.raw) and r.raw == 0))
            streak = streak + 1 if bad else 0
            fires = bad and streak >= threshold and not alerted
            alerted = bad and (alerted or fires)
            rows.append((key[0], r.run, streak, fires))
        state.update((streak, alerted))
        yield pd.DataFrame(rows, columns=["source", "run", "streak", "alert"])

    return runs.groupBy("source").applyInPandasWithState(step, "source string, run bigint, streak bigint, alert boolean", "streak bigint, alerted boolean", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def feed_writer(read: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[DataFrame, DataFrame, DataFrame, int], None], as_of: Callable[[], object]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merges each batch of fresh postings with what ``read`` gives
    (previous feed, ledger) and hands (feed, ledger, new, batch id) to ``write``, which is
    expected to be idempotent by batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        previous, ledger = read()
        write(*merge_feed(batch, previous, ledger, as_of()), batch_id)

    return run
