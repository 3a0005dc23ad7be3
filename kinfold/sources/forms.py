"""A stored dictionary of values and their forms: each distinct value is worked out once, however many rows and batches have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that are sent to all tasks; beyond that rows are joined by a shuffle.
MOST_BROADCAST = 1 << 18


class Forms:
    """Forms of strings under path: value and a column for each form. Values are only added; batch by batch, one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, forms: dict[str, Callable[[Column], Column]]):
        self.spark, self.path, self.forms = spark, path.rstrip("/"), forms
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._there = lambda: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        schema = "value string, " + ", ".join(f"`{f}` string" for f in self.forms)
        return self.spark.read.schema(schema).parquet(self.path) if self._there() else self.spark.createDataFrame([], schema)

    def extend(self, values: DataFrame, column: str) -> int:
        """Add the values of a column that are not there yet, and say how many: these alone go through the forms' expressions. Nulls are left out; an added batch that runs again adds nothing."""
        known = self.read()
        new = values.select(F.col(column).alias("value")).where("value is not null").distinct().join(known.select("value"), "value", "left_anti")
        before = known.count()
        rows = new.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "value")
        rows.select("value", *(f(F.col("value")).cast("string").alias(name) for name, f in self.forms.items())).write.mode("append").parquet(self.path)
        return self.read().count() - before

    def join(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with the forms of a column; null where it is null or not in the dictionary. Equal values meet by hash; a small dictionary is sent to the rows instead."""
        forms = self.read().withColumnRenamed("value", "__value")
        forms = F.broadcast(forms) if forms.count() <= MOST_BROADCAST else forms
        return rows.join(forms, F.col(column) == F.col("__value"), "left").drop("__value")
