"""Pages of a sorted table that do not sort it again: parts in order, and a directory of what each holds.

One range-partitioned pass writes the parts; the directory has a row for each (its number, its rows, and those before it). A page
opens the one or two parts that it lies in, whatever its number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pages(rows: DataFrame, by: list[Column], path: str, parts: int = 200) -> None:
    """Write rows in order to so many parts at most. by should tell all rows apart, if pages are to be the same each time they are written."""
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    spark, schema = rows.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.drop("part").schema)
    # Counted from the files' footers: no column is read. A row of no part has the schema, which an empty table keeps as well.
    count = spark.read.schema("place long, part int").parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n")).withColumn("schema", F.lit(None).cast("string"))
    count.union(spark.createDataFrame([(-1, 0, schema)], "part int, n long, schema string")).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


@dataclass(frozen=True)
class Pages:
    """A table of write_pages(), its directory read once: as many rows as there are parts."""

    spark: SparkSession
    path: str
    schema: str
    counts: tuple[tuple[int, int], ...]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Pages:
        (_, _, schema), *found = sorted(tuple(r) for r in spark.read.parquet(f"{path}/directory").collect())
        return cls(spark, path, schema, tuple((part, n) for part, n, _ in found))

    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def read(self, parts: list[int]) -> DataFrame:
        """The rows of some parts, in no order."""
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("place")
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/rows/part={p}" for p in parts)).drop("place")

    def parts(self, number: int, size: int = 50) -> tuple[list[int], int]:
        """The parts that a page lies in, and how many of their rows come before it. Numbers out of range are brought into it."""
        last = max(1, -(-self.total() // size))
        start = (min(max(1, number), last) - 1) * size
        out, before, skip = [], 0, 0
        for part, n in self.counts:
            if before < start + size and before + n > start:
                skip = skip if out else start - before
                out.append(part)
            before += n
        return out, skip

    def page(self, number: int, size: int = 50) -> DataFrame:
        """The rows of a page, in order."""
        parts, skip = self.parts(number, size)
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("place")
        rows = self.spark.read.schema(f"{self.schema}, part int").option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/part={p}" for p in parts))
        # Within a part rows are numbered as they were sorted, so a page is a range of places, counted on from part to part.
        counts, start, starts = dict(self.counts), 0, []
        for p in parts:
            starts += [F.lit(p), F.lit(start).cast("long")]
            start += counts[p]
        at = F.element_at(F.create_map(*starts), F.col("part")) + F.col("place")
        return rows.where((at >= skip) & (at < skip + size)).orderBy("part", "place").drop("part", "place")
