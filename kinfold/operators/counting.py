"""Counts and scans that stop: rows are read in growing rounds until a limit is reached, so that they cost what the limit costs, not the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pages import Pages

#: How much more each round reads than all before it.
GROWTH = 4


def count_up_to(rows: DataFrame, limit: int) -> int:
    """The number of rows, or limit if there are more. Partitions are tried in growing rounds, as take() does; at most limit empty rows come back."""
    return len(rows.select().take(limit)) if limit > 0 else 0


def first_that(pages: Pages, keep: Callable[[DataFrame], DataFrame], by: list[Column], limit: int) -> tuple[DataFrame, int]:
    """The first `limit` rows that keep() leaves of a table of write_pages() by `by`, and how many rows were read for them.

    keep() takes rows of the table and must judge each by itself or by tables of its own. Parts are read in order, one, then
    GROWTH times as many as before, until enough are left; a limit below 1 reads none.
    """
    parts, read = [p for p, _ in pages.counts], 0
    if limit < 1 or not parts:
        return keep(pages.read([])).limit(0), 0
    while read < len(parts):
        read = min(len(parts), max(1, read * GROWTH))
        left = keep(pages.read(parts[:read]))
        if read == len(parts) or count_up_to(left, limit) >= limit:
            break
    return left.orderBy(*by).limit(limit), sum(n for _, n in pages.counts[:read])


def preview(rows: DataFrame, cap: int) -> DataFrame:
    """n, capped: the number of rows up to cap, and whether there are more. One row; no task counts more than cap + 1."""
    some = rows.select().limit(cap + 1).agg(F.count("*").alias("n"))
    return some.select(F.least("n", F.lit(cap)).alias("n"), (F.col("n") > cap).alias("capped"))
