"""Append-only versions of records, private fields, and their merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_key(content: list[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))


def changed_versions(versions: DataFrame, key: str, order: str, content: list[str]) -> DataFrame:
    """Versions whose content differs from the one before; going back to older content counts."""
    now = F.struct(*content)
    before = F.lag(now).over(Window.partitionBy(key).orderBy(order))
    return versions.withColumn("_b", before).where(~F.col("_b").eqNullSafe(now)).drop("_b")


def diff_versions(versions: DataFrame, key: str, order: str, labels: dict[str, str]) -> DataFrame:
    """``changed``: labels, in order, of the columns that differ from the version before (null for a first one)."""
    w = Window.partitionBy(key).orderBy(order)
    marks = [F.when(~F.lag(c).over(w).eqNullSafe(F.col(c)), F.lit(name)) for c, name in labels.items()]
    first = F.row_number().over(w) == 1
    return versions.withColumn("changed", F.when(~first, F.array_compact(F.array(*marks))))


def latest(versions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest version of each key."""
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def merge_versions(current: DataFrame, other: DataFrame, key: str = "id", updated: str = "updatedAt") -> DataFrame:
    """Union by id; the later edit stays, the current one where both are of one time."""
    both = current.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, [F.desc(updated), F.asc("_side")]).drop("_side")


def versions_for(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Versions by job id or fingerprint: two equality joins, each version once; blanks match nothing."""
    j = jobs.select(F.col("id").alias("_id"), F.col("fingerprint").alias("_fp"))
    by_id = versions.join(j.where("_id <> ''"), F.col("jobId") == F.col("_id")).select("*", F.col("_id").alias("for_job"))
    by_fp = versions.join(j.where("_fp <> ''"), F.col("jobFingerprint") == F.col("_fp")).select("*", F.col("_id").alias("for_job"))
    return by_id.unionByName(by_fp).drop("_id", "_fp").dropDuplicates(["for_job", "id"])


def valid_versions(versions: DataFrame) -> DataFrame:
    """Well-formed rows, the first of each id."""
    ok = versions.where("id <> '' AND appliedAt IS NOT NULL AND (jobId <> '' OR jobFingerprint <> '')")
    return latest(ok, "id", [F.asc("seq")])


def merge_private(vault: DataFrame, local: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Private fields by key; the vault's values win field by field."""
    v, loc = (x.select(key, *[F.col(f).alias(f"{p}_{f}") for f in fields]) for x, p in ((vault, "v"), (local, "l")))
    return v.join(loc, key, "full").select(key, *[F.coalesce(f"v_{f}", f"l_{f}").alias(f) for f in fields])


def with_private(rows: DataFrame, key: str, value: str, field: str, new: Column) -> DataFrame:
    """Set a private field of one key; a null removes it, and a key without fields goes."""
    fields = [c for c in rows.columns if c != key]
    out = rows.withColumn(field, F.when(F.col(key) == value, new).otherwise(F.col(field)))
    return out.where(F.coalesce(*[F.col(f).isNotNull().cast("int") for f in fields], F.lit(0)).isNotNull() & F.greatest(*[F.col(f).isNotNull() for f in fields], F.lit(False)))


def split_private(rows: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(public rows, private fields by id); a field is lifted only where it holds an object."""
    private = rows.where(F.greatest(*[F.col(f).isNotNull() for f in fields], F.lit(False))).select("id", *fields)
    return rows.drop(*fields), private
