"""A feed laid out for a list that is turned page by page.

Rows are written in files of ``rows`` each in the order of the list (range partitioned, numbered over
tasks), so a page is found without sorting: by its number, which gives the file, or after the row a
reader saw last, by the first row of each file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import drop_table, materialise

ROWS = 10_000


def write_pages(feed: DataFrame, order: list[Column], path: str, rows: int = ROWS) -> None:
    """Write ``feed`` with ``place`` (from 0, by ``order``, which should tell all rows apart) in files of ``rows``."""
    names = feed.columns
    dealt = feed.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n))], [*names, "_part", "_at"])
            at += n

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in feed.schema] + ["_part int", "_at bigint"])
    numbered = materialise(dealt.mapInArrow(number, schema), "pages")
    parts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")
    placed = placed.withColumn("place", F.col("_before") + F.col("_at")).withColumn("file", F.floor(F.col("place") / rows))
    files = placed.select(*names, "place", "file").repartition("file").sortWithinPartitions("file", "place")
    files.write.partitionBy("file").mode("overwrite").parquet(f"{path}/rows")
    firsts = feed.sparkSession.read.schema(files.schema).parquet(f"{path}/rows").where(F.col("place") % rows == 0).withColumn("per_file", F.lit(rows))
    firsts.coalesce(1).write.mode("overwrite").parquet(f"{path}/firsts")  # a row a file
    drop_table(numbered)


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (from 0), in order; of one file where ``size`` divides the rows of a file."""
    first, last = number * size, (number + 1) * size - 1
    rows = _per_file(spark, path)
    near = _rows(spark, path).where((F.col("file") >= first // rows) & (F.col("file") <= last // rows))
    return near.where(F.col("place").between(first, last)).orderBy("place").drop("file")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/firsts").drop("per_file").schema).parquet(f"{path}/rows")


def _per_file(spark: SparkSession, path: str) -> int:
    one = spark.read.parquet(f"{path}/firsts").select("per_file").first()
    return one[0] if one else ROWS


def page_after(spark: SparkSession, path: str, past: Column, size: int) -> DataFrame:
    """The next ``size`` rows in the list of those for which ``past`` holds (that a row stands behind the one
    seen last, in the list's order).  The first row of each file says where to begin."""
    start = spark.read.parquet(f"{path}/firsts").where(~past).agg(F.max("file")).first()[0] or 0
    near = _rows(spark, path).where(F.col("file").between(start, start + 1 + size // _per_file(spark, path)))
    return near.where(past).orderBy("place").limit(size).drop("file")
