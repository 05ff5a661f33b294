"""A keyed table of hash buckets that is changed by merging, bucket by bucket.

Rows lie in Parquet folders, one for each bucket of their key's hash.  A merge joins the
updates with the buckets they fall into, writes these anew beside the old ones and then writes a
manifest that names each bucket's folder.  The manifest with the highest number counts: readers see
all of a merge or nothing, files of untouched buckets keep their names, and a merge that dies
leaves folders that no manifest names (:meth:`BucketTable.vacuum` removes them).

A manifest is created only where none with its number exists, so of two merges from one state the
second fails and may be tried again on the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketTable:
    """``schema`` holds ``key`` (one column, no nulls, distinct in the table).

    Rows lie in the bucket of ``by``, a column that the key determines (the key itself by default), in
    up to ``spread`` files, so that a ``by`` with many rows is not one task's.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema: StructType | str, buckets: int = 64, by: str | None = None, spread: int = 1):
        self.spark, self.root, self.key, self.buckets, self.by, self.spread = spark, root.rstrip("/"), key, buckets, by or key, spread
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    # -- files: manifests are a line a bucket, whatever the table's size

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._path("manifests"), self._fs()
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """(version, bucket -> folder) of the newest manifest, or of a given one."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, {}
        stream = self._fs().open(self._path(f"manifests/{version:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return version, {int(k): v for k, v in json.loads(text).items()}

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        fs, temporary = self._fs(), self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        stream.write(json.dumps(folders).encode())
        stream.close()
        final = self._path(f"manifests/{version:012d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {version} of {self.root} was written by another merge")

    # -- reading

    def bucket_of(self, by: Column) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(list(self.manifest(version)[1].values()))

    def lookup(self, values: DataFrame) -> DataFrame:
        """Rows whose ``by`` is in ``values`` (a column of that name), from the buckets these fall into."""
        folders = self.manifest()[1]
        touched = self._touched(values)
        return self._read([f for b, f in folders.items() if b in touched]).join(values.select(self.by).distinct(), self.by, "left_semi").select(*self.schema.fieldNames())

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket_of(F.col(self.by))).distinct().collect()}  # at most ``buckets``

    # -- writing

    def merge(self, updates: DataFrame, change: Callable[[Callable[[str], Column], Callable[[str], Column], Column], dict[str, Column]] | None = None, insert: bool = True) -> int:
        """Merge rows of the table's columns, one a key, and return the new version.

        ``change(old, new, known)`` gives the columns of a row that was touched, from functions that
        name its columns on both sides and whether it was there; by default new values that
        are not null win.  Without ``insert`` unknown keys are left out.  ``updates`` is read twice
        (buckets, then rows), so should be cheap or written.
        """
        version, folders = self.manifest()
        touched = self._touched(updates)
        if not touched:
            return version
        names = self.schema.fieldNames()
        old = self._read([f for b, f in folders.items() if b in touched]).select(F.col(self.key), F.struct(*names).alias("_old"))
        new = updates.select(F.col(self.key), F.struct(*names).alias("_new"))
        both = old.join(new, self.key, "full" if insert else "left")
        known, hit = F.col("_old").isNotNull(), F.col("_new").isNotNull()
        was, now = (lambda c: F.col(f"_old.{c}")), (lambda c: F.col(f"_new.{c}"))
        cols = {c: F.coalesce(now(c), was(c)) for c in names} | (change(was, now, known) if change else {})
        out = both.select(F.col(self.key), *[F.when(hit, cols[c]).otherwise(was(c)).alias(c) for c in names if c != self.key])
        fresh = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
        placed = out.select(*names, self.bucket_of(F.col(self.by)).alias("_bucket"))
        placed = placed.repartition(len(touched) * self.spread, "_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.spread)))
        placed.write.partitionBy("_bucket").parquet(f"{self.root}/{fresh}")
        written = {b: f"{fresh}/_bucket={b}" for b in touched if self._fs().exists(self._path(f"{fresh}/_bucket={b}"))}
        self._commit(version + 1, {b: f for b, f in folders.items() if b not in touched} | written)
        return version + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` manifests names, and older manifests."""
        fs, versions = self._fs(), self.versions()
        used = {f for v in versions[-keep:] for f in self.manifest(v)[1].values()}
        gone, data = 0, self._path("data")
        for run in fs.listStatus(data) if fs.exists(data) else []:
            name = f"data/{run.getPath().getName()}"
            for s in fs.listStatus(run.getPath()):
                if s.isDirectory() and f"{name}/{s.getPath().getName()}" not in used:
                    fs.delete(s.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        return gone
