"""Classification of scored candidates of a notice: band, hard-conflict cap, ambiguity, runner-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least totals of the bands.
BANDS = [("strong", 85), ("probable", 70), ("possible", 55), ("weak", 40), ("none", 0)]


def band(total: Column) -> Column:
    out = F.when(total >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:-1]:
        out = out.when(total >= least, name)
    return out.otherwise("none")


def capped_band(total: Column, hard: Column) -> Column:
    """The band of a total; with a hard conflict possible at most."""
    return F.when(hard & (total >= BANDS[1][1]), "possible").otherwise(band(total))


def reasons(total: Column, hard: Column, ambiguous: Column, gap: int = 10) -> Column:
    """Why a match is classified as it is."""
    return F.array_compact(F.array(F.concat(F.lit("score "), total.cast("string")), F.when(hard & (total >= BANDS[1][1]), "capped to possible by a hard conflict"), F.when(ambiguous, f"runner-up within {gap} points")))


def classify(scored: DataFrame, notice: str, total: str, hard: str, seq: str, gap: int = 10) -> DataFrame:
    """scored with rank, band, ambiguous, second, reasons: one window over each notice's candidates.

    The best is the first by total, then seq. The second is the best of the others, without hard conflicts unless the best has one.
    """
    w = Window.partitionBy(notice)
    out = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc(total), F.asc(seq))))
    out = out.withColumn("best_hard", F.max(F.when(F.col("rank") == 1, F.col(hard))).over(w))
    out = out.withColumns({"best": F.max(F.when(F.col("rank") == 1, F.col(total))).over(w), "second": F.max(F.when((F.col("rank") > 1) & (F.col("best_hard") | ~F.col(hard)), F.col(total))).over(w)})
    unsure = F.coalesce((F.col("best") >= 55) & (F.col("best") - F.col("second") < gap), F.lit(False))
    out = out.withColumns({"band": capped_band(F.col(total), F.col(hard)), "ambiguous": unsure & (F.col("rank") == 1)}).drop("best_hard", "best")
    return out.withColumn("reasons", reasons(F.col(total), F.col(hard), F.col("ambiguous"), gap))


def runner_up(ranked: DataFrame, notice: str, person: Column) -> DataFrame:
    """Of classify()'s rows the best of each notice with the struct person of its runner-up (rank 2), or null."""
    second = F.max_by(F.when(F.col("rank") == 2, person), F.when(F.col("rank") == 2, 1))
    best = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    return ranked.groupBy(notice).agg(*(best(c) for c in ("total", "band", "ambiguous")), second.alias("runner_up"))
