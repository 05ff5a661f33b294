"""Tables in the shared folder, and connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster
    that would lose files with a machine, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):  # one JVM
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends there and a lost executor costs only the tasks it was running.  The
    table stays until the folder is cleaned, as a lazily read result may still need it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote and nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components: ``edges(a, b)`` long -> ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps, after Kiveris et al., "Connected
    Components in MapReduce and Beyond" (2014).  Each step moves every node's
    neighbours to its smallest one, so edges never outnumber those given, no group of
    neighbours is gathered in one place, and the number of rounds grows with the
    logarithm of the largest component.  Every round is written to the shared folder, and the
    one before it deleted.  Nodes without an edge do not appear.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # a large-star edge points at a smaller node already
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        drop_table(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
