"""Join of rows whose ranges overlap, as an equi-join by bins: no nested loop, no pair of bins that cannot meet.

Bins of a level are twice as wide as those of the one below. A range's own level is the finest whose bins are no narrower
than it, so it lies in one or two of them. Two ranges meet at the coarser of their levels: the one of that level in its own bins, the
other lifted to them. They are reported in the first bin that both lie in, once.

Rows that agree in `on` and are few need no bins: each moves once, by `on`, and meets all others of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a bin that one task takes; bins with more are split.
BIN_ROWS = 1 << 14
#: Groups that agree in `on` meet without bins if one side has so many rows at most, and neither more than BIN_ROWS.
WHOLE_ROWS = 256
#: Split bins that are sent to all tasks; beyond that they are joined by a shuffle.
MOST_BROADCAST = 1 << 18


def _level(length: Column) -> Column:
    """The least k with 2 ** k >= length."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def _prepared(df: DataFrame, lo: str, hi: str, on: tuple[str, ...], base: int, top: int) -> DataFrame:
    """__row, on, __a, __b (offsets from base), __level of the rows that have a range."""
    known = (F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) <= F.col(hi))) if lo != hi else F.lit(True)
    a, b = (F.coalesce(F.col(c).cast("long"), F.lit(end)) - base for c, end in ((lo, base), (hi, top)))
    rows = df.where(known).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), *on, a.alias("__a"), b.alias("__b"))
    return rows.withColumn("__level", _level(F.col("__b") - F.col("__a") + 1))


def _bins(rows: DataFrame, level: Column) -> DataFrame:
    """rows by the one or two bins of a level that each lies in."""
    rows = rows.withColumn("__at", level)
    first, last = F.call_function("shiftright", F.col("__a"), F.col("__at")), F.call_function("shiftright", F.col("__b"), F.col("__at"))
    return rows.withColumn("__bin", F.explode(F.sequence(first, last)))


def _levels(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("__level").distinct().collect())  # at most 64


def _meet(own: DataFrame, lifted: DataFrame, on: list[str], bin_rows: int) -> DataFrame:
    """Pairs of rows of own and of lifted that overlap. Of bins that are hot on a side that side is dealt to parts, and the other is sent to each."""
    keys = [*on, "__at", "__bin"]
    count = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / bin_rows).cast("int").alias(name)).where(F.col(name) > 1)
    hot = count(own, "__own").join(count(lifted, "__lifted"), keys, "full_outer")
    hot = hot.select(*keys, F.coalesce("__own", F.lit(1)).alias("__own"), F.coalesce("__lifted", F.lit(1)).alias("__lifted"))

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        rows = rows.join(hot, keys, "left")
        part = F.pmod(F.xxhash64("__a", "__b", F.monotonically_increasing_id()), F.coalesce(mine, F.lit(1))).cast("int")
        return rows.withColumn(f"{mine}_part", part).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("__own", "__lifted")

    a, b = dealt(own, "__own", "__lifted"), dealt(lifted, "__lifted", "__own").withColumnsRenamed({"__row": "__row2", "__a": "__a2", "__b": "__b2"}).drop("__level")
    pairs = a.join(b, [*keys, "__own_part", "__lifted_part"])
    first = F.call_function("shiftright", F.greatest("__a", "__a2"), F.col("__at"))
    return pairs.where((F.col("__a") <= F.col("__b2")) & (F.col("__a2") <= F.col("__b")) & (F.col("__bin") == first)).select("__row", "__row2")


def _crowded(x: DataFrame, y: DataFrame, on: list[str], bin_rows: int) -> DataFrame:
    """The values of `on` whose rows of both sides are too many to meet whole."""
    count = lambda rows, name: rows.groupBy(*on).agg(F.count("*").alias(name))
    sizes = count(x, "__m").join(count(y, "__n").hint("merge"), on)
    return sizes.where((F.least("__m", "__n") > min(WHOLE_ROWS, bin_rows)) | (F.greatest("__m", "__n") > bin_rows)).select(*on)


def overlap_join(left: DataFrame, right: DataFrame, lo: str = "lo", hi: str = "hi", on: list[str] | tuple[str, ...] = (), bin_rows: int = BIN_ROWS) -> DataFrame:
    """l, r: all pairs of rows (as structs) whose closed ranges [lo, hi] of integers overlap, and that agree in `on`.

    A null lo or hi is an open end; a range whose hi is below its lo is empty and meets nothing, nor does a row with a null
    in `on`. Repeated rows make pairs each. Other columns, of whatever names, only come along. Empty tables give none.
    Groups by `on` that are not crowded are an equi-join by `on`, of at most WHOLE_ROWS tests for each row of the larger side.
    For the others the work is that of an equi-join by (on, level, bin) in which a row stands at most twice for each of the (at most 64)
    levels that the other side has; what meets in a bin is no farther apart than two of its widths.
    """
    ends = left.select(lo, hi).unionAll(right.select(lo, hi)).agg(*(f(c) for f in (F.min, F.max) for c in (lo, hi))).first()
    known = [int(x) for x in ends if x is not None] or [0]
    base, top, on = min(known), max(known), list(on)
    x, y = (_prepared(df, lo, hi, tuple(on), base, top) for df in (left, right))
    level, whole = F.col("__level"), None
    if on:
        few = lambda rows: rows.select("__row", *on)
        crowded, p, q = _crowded(x, y, on, bin_rows), few(x), few(y)
        if some := not crowded.isEmpty():
            p, q, x, y = p.join(crowded, on, "left_anti"), q.join(crowded, on, "left_anti"), x.join(crowded, on, "left_semi"), y.join(crowded, on, "left_semi")
        end = lambda row, c, open_end: F.coalesce(F.col(row)[c].cast("long"), F.lit(open_end))
        pairs = p.join(q.withColumnRenamed("__row", "__row2").hint("merge"), on)
        meet = (end("__row", lo, base) <= end("__row2", hi, top)) & (end("__row2", lo, base) <= end("__row", hi, top))
        whole = pairs.where(meet).select(F.col("__row").alias("l"), F.col("__row2").alias("r"))
        if not some:
            return whole

    def lift(rows: DataFrame, levels: list[int], strictly: bool) -> DataFrame:
        at = F.explode(F.filter(F.lit(levels).cast("array<int>"), lambda k: (k > F.col("__level")) if strictly else (k >= F.col("__level"))))
        return _bins(rows.withColumn("__to", at), F.col("__to")).drop("__to")

    one = _meet(_bins(x, level), lift(y, _levels(x), False), on, bin_rows).select(F.col("__row").alias("l"), F.col("__row2").alias("r"))
    two = _meet(_bins(y, level), lift(x, _levels(y), True), on, bin_rows).select(F.col("__row2").alias("l"), F.col("__row").alias("r"))
    return one.unionAll(two) if whole is None else one.unionAll(two).unionAll(whole)
