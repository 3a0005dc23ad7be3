"""A folder that all executors share, for tables that a query writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path under spark.checkpoint.dir; where that is unset, under the temp folder if all runs on this machine. It goes with the driver's end."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        top = f"file://{tempfile.gettempdir()}/kinfold-shared"
    path = f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back: what follows neither plans nor works it out again, and survives a lost executor."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._kinfold_path = path
    return back


def drop_staged(df: DataFrame) -> None:
    """Delete what staged() wrote, once nothing lazy reads it any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kinfold_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
