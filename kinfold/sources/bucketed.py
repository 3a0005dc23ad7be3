"""Tables bucketed and sorted by a key, so that joins and sums by it move nothing.

A tree's people, their facts and their matches are joined by person again and again; dealt once when they are written, each
join reads bucket by bucket. Tables of different numbers of buckets are still joined rightly, by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .folders import scratch


def write_bucketed(rows: DataFrame, name: str, key: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write rows as a table of so many buckets, sorted by key within each, and return it. path: a folder that all executors share.

    Nulls in the key are a bucket's rows like others. A table of that name is replaced.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(buckets, *key)  # one file a bucket
    dealt.write.mode("overwrite").option("path", path or scratch(spark, name)).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return spark.table(name)


def bucket_counts(spark: SparkSession, names: Iterable[str]) -> dict[str, tuple[int, tuple[str, ...]] | None]:
    """Number of buckets and key of each table; None for one that is not bucketed."""
    out: dict[str, tuple[int, tuple[str, ...]] | None] = {}
    for name in names:
        said = {r.col_name.strip(): r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").collect()}
        number = int(said.get("Num Buckets", 0) or 0)
        out[name] = (number, tuple(c.strip(" `[]") for c in said["Bucket Columns"].split(","))) if number > 0 else None
    return out


def co_located(spark: SparkSession, names: Iterable[str]) -> bool:
    """Whether joins by their key of all these tables need no shuffle: bucketed, by one key, in equal numbers."""
    found = list(bucket_counts(spark, names).values())
    return bool(found) and None not in found and len(set(found)) == 1
