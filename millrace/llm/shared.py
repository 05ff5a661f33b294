"""What several operators need: the shared folder, tables written to cut lineage,
Arrow batches cut at key boundaries, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components, materialise, new_path, shared_dir

__all__ = ["components", "forest", "labelled_sample", "materialise", "new_path", "ranked", "run_bounds", "shared_dir", "spread_join", "table", "two_sided_forest", "whole_groups"]

#: A key is hot from this number of rows on, and so many keys are hot at most.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, <label>), written: at most ``most`` rows, half of them of each class (0, 1).

    Rows are drawn by hash of doc_id, a doc_id's label is its largest.  A doc_id may have
    several rows; all are candidates, and the bound is on rows.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    first = lambda *by: F.row_number().over(Window.partitionBy(label).orderBy(*by))
    known = known.withColumn("_d", F.xxhash64("doc_id")).withColumn("_n", first("_d", "doc_id")).where(F.col("_n") <= most // 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(known.drop("_n")), "doc_id")  # ``most`` ids
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_n", first("_d", "doc_id", "_h")).where(F.col("_n") <= most // 2)
    return materialise(rows.select("doc_id", "text", label), f"sample-{label}")


def spread_join(rows: DataFrame, values: DataFrame, key: str, n: str, keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` left-joined by ``key`` with ``values`` (written; one row a key; ``n`` is the number
    of rows that have it), without ``n``.

    Hot keys stay where they are and get their values by broadcast.  A key counts as hot from
    a share of 1 / ``keys`` of all rows on, so there are never more than ``keys`` of them.
    """
    total = values.agg(F.sum(n)).first()[0] or 0
    hot = values.where(F.col(n) >= max(HOT_ROWS, -(-total // keys))).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.drop(n), key, "left")
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of equal keys is cut.

    The rows must be sorted by ``keys``.  Memory holds one batch and one run; callers
    bound the runs beforehand.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            col = np.asarray(batch.column(k))
            same &= col == col[last]
        breaks = np.flatnonzero(~same)
        cut = int(breaks[-1]) + 1 if len(breaks) else 0
        if cut or (held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys)):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in aligned sorted columns."""
    n = len(cols[0])
    change = np.zeros(n, bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n)


def forest(nodes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) that connect what ``linked`` (a symmetric
    boolean matrix) connects: at most one edge a node, whatever the number of links."""
    n = len(nodes)
    order = np.argsort(nodes, kind="stable")
    linked = linked[np.ix_(order, order)]
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i] = i
        front = np.zeros(n, bool)
        front[i] = True
        while front.any():
            front = linked[front].any(0) & (label < 0)
            label[front] = i
    far = label != np.arange(n)
    ranked = nodes[order]
    return ranked[far], ranked[label[far]]


def two_sided_forest(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for links between two lists of nodes (a boolean matrix, rows by columns)."""
    row_left, col_left = np.ones(len(left), bool), np.ones(len(right), bool)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for i in range(len(left)):
        if not row_left[i]:
            continue
        row_left[i] = False
        front, members = np.array([i]), [left[i : i + 1]]
        while len(front):
            cols = np.flatnonzero(linked[front].any(0) & col_left)
            col_left[cols] = False
            members.append(right[cols])
            front = np.flatnonzero(linked[:, cols].any(1) & row_left)
            row_left[front] = False
            members.append(left[front])
        own = np.concatenate(members)
        low = own.min()
        a.append(own[own != low])
        b.append(np.full(len(a[-1]), low))
    empty = [np.empty(0, left.dtype)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx`` (long), a row's place from 0 among those alike in ``group`` by ``order``.

    ``group`` holds no nulls; nulls in ``order`` come first.  Rows are dealt by ranges of group and
    order (and their place in the table written here, so that repeated rows part too): a group
    with a third of all rows is many tasks.  Each numbers its rows; a group that goes over
    from one task to the next is its first or last one, so the numbers to add are at most two a
    task and are broadcast.
    """
    cols = rows.columns
    rows = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), f"{name}-rows")
    dealt = rows.repartitionByRange(group, *order, "_at").sortWithinPartitions(group, *order, "_at").select(*cols)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(group)
            starts = np.append(0, np.flatnonzero(pc.not_equal(own.slice(1), own.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1)
            place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            if own[0] == last:
                place[: starts[1] if len(starts) > 1 else n] += seen
            last, seen = own[n - 1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(place, pa.int64())], [*cols, "_part", "_place"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema] + ["_part int", "_place bigint"])
    rows = materialise(dealt.mapInArrow(number, schema), name)
    edges = rows.groupBy("_part").agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))  # a row a task
    edge = rows.select("_part", F.col(group).alias("_g")).join(F.broadcast(edges), "_part").where("_g = _lo or _g = _hi").groupBy("_g", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    add = materialise(edge.select("_g", F.col("_part").alias("_p"), before.alias("_add")).where("_add > 0"), f"{name}-edges")
    out = rows.join(F.broadcast(add), (rows[group] == add["_g"]) & (rows["_part"] == add["_p"]), "left")
    return out.select(*cols, (F.col("_place") + F.coalesce("_add", F.lit(0))).alias("idx"))
