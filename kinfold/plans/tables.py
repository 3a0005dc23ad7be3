"""The driver's tables, and how their rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, *key: str | Column) -> DataFrame:
    """df dealt by key to as many tasks as a shuffle has: what follows costs far more a row than its move, and a small file, or one of few row groups, would be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
