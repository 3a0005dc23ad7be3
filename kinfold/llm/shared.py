"""Tables in the folder that all executors share, and connected components built on them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one under the temp folder if all runs on this machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"file://{tempfile.gettempdir()}/kinfold-shared"


def _path_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Spark's setting by which an execution's shuffle files go at its end, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and outlives any executor. It goes with the driver's end, if not dropped before.

    What was shuffled to write it goes at once, as nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    fs, p = _path_of(spark, path)
    fs.deleteOnExit(p)
    back = spark.read.schema(df.schema).parquet(path)
    back._kinfold_path = path
    return back


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast in a join if it has no more than so many rows, else left to a shuffle. df should be a stored table, as its rows are counted."""
    return F.broadcast(df) if df.count() <= most else df


def drop_stored(df: DataFrame) -> None:
    """Delete a table that store() wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_kinfold_path", None)
    if path:
        fs, p = _path_of(df.sparkSession, path)
        fs.delete(p, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph (u, v), by alternating large-star and small-star rounds.

    Returns node, component for every node of an edge; component is the smallest node. Null ends and loops are
    ignored, repeated edges count once. Every round is a pair of aggregations and equi-joins whose output is no
    larger than its input; rounds grow with the logarithm of the longest path. Hubs are pre-aggregated (min) on the
    way in and, being plain sort-merge joins, split by adaptive skew handling on the way out.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = store(e, "cc")
    state = None
    while True:
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or tuple(sign) == state:
            break
        state = tuple(sign)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = store(small, "cc")
        drop_stored(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
