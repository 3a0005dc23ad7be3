"""Drains of several finders under one supervisor: each has its own folder and checkpoint, and none stops the others."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedStore
from . import drain as D

NUMBERS = ("ingested", "skipped", "failed", "stored")


@dataclass
class FanOut:
    """Sums over the finders' batches of this run, which finders failed at last and why, and an exit code: 0 if none did."""

    sums: dict[str, int]
    failures: dict[str, str] = field(default_factory=dict)
    restarts: dict[str, int] = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        return 1 if self.failures else 0


def by_finder(jobs: DataFrame) -> DataFrame:
    """finder_id, ingested, skipped, failed, stored of Drained.jobs by finder; the row of a null finder_id and total = true has the sums."""
    action = F.col("action")
    counts = (
        F.count_if(action == "ingest").alias("ingested"), F.count_if(action == "release").alias("skipped"), F.count_if(action.isin("failed", "unknown_tree")).alias("failed"),
        F.coalesce(F.sum("matches_stored"), F.lit(0)).alias("stored"), (F.grouping("finder_id") == 1).alias("total"),
    )
    return jobs.rollup("finder_id").agg(*counts)


def drain_all(spark: SparkSession, landings: dict[str, str], out: str, checkpoints: str, people: str, restarts: int = 1, pause: float = 5.0, timeout: float = 3_600, **options) -> FanOut:
    """Drain the folders of all finders, one after the other (a keyed store has one writer), each until it has no more files.

    A finder whose stream fails is started anew, up to `restarts` times, after the others have had their turn and a pause; what it
    had committed stays. options are drain()'s.
    """
    store = KeyedStore(spark, f"{out}/state", D.TABLES, options.get("buckets", 64))
    before, result = store.pointer().marks, FanOut(dict.fromkeys(NUMBERS, 0))
    turn = list(landings)
    for attempt in range(restarts + 1):
        failed = []
        for finder in turn:
            try:
                query = D.drain(spark, landings[finder], out, f"{checkpoints}/{finder}", people, source=finder, **options)
                if not query.awaitTermination(timeout):
                    query.stop()
                    raise TimeoutError(f"not done within {timeout} seconds")
                result.failures.pop(finder, None)
            except Exception as e:  # whatever one finder's stream fails of
                failed.append(finder)
                result.failures[finder] = f"{type(e).__name__}: {e}".splitlines()[0]
        if not failed or attempt == restarts:
            break
        for finder in failed:
            result.restarts[finder] = attempt + 1
        turn = failed
        time.sleep(pause)
    after = store.pointer().marks
    paths = [f"{out}/summary/batch={f}{k}" for f in landings for k in range(before.get(f, -1) + 1, after.get(f, -1) + 1)]
    if paths:
        row = spark.read.parquet(*paths).agg(*(F.sum(c).alias(c) for c in NUMBERS)).first()
        result.sums = {c: row[c] or 0 for c in NUMBERS}
    return result
