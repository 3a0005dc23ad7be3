"""The ledger of jobs that finders are at work on: what is asked for, who has claimed it, and what a drain takes from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import SAFE_JOB_ID, STALE_AFTER

#: The most bytes of an entry's JSON; a larger one could be written but not read back.
ENTRY_BYTES = 65_536

_STATE = "struct<held:boolean,claimed_at:long,tree_id:int,requested_person_ids:array<string>,outcomes:array<string>>"


def entry_json(job_id: Column, tree_id: Column, people: Column, submitted_at: Column) -> Column:
    return F.to_json(F.struct(job_id.alias("jobId"), tree_id.alias("treeId"), people.alias("requestedPersonIds"), submitted_at.alias("submittedAt")))


def replay(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """ledger (job_id, tree_id, requested_person_ids, claimed_at) after events (job_id, at, seq, event, tree_id, requested_person_ids), with outcomes.

    Events of a job take place by at (seconds), then seq; outcomes has one for each. record: recorded (queued, what was
    asked before being overwritten), or refused if the id is not safe or the entry too large. claim: claimed, if the job is
    queued or its claim is stale; lost otherwise, as when there is no such job. release: released if claimed. remove:
    removed if there. Else unchanged. Null or unsafe ids change nothing. claimed_at is null while a job is queued. held is
    false for a job that is not in the ledger at the end; only its outcomes are of use. A job's events are an array, its history.
    """
    safe = F.coalesce(F.col("job_id").rlike(SAFE_JOB_ID), F.lit(False))
    fits = F.octet_length(entry_json(F.col("job_id"), F.col("tree_id"), F.col("requested_person_ids"), F.col("at"))) <= ENTRY_BYTES
    rows = events.withColumns({"__safe": safe, "__fits": F.coalesce(fits, F.lit(False))})
    step_of = F.struct("at", "seq", "event", "tree_id", "requested_person_ids", (F.col("__safe") & F.col("__fits")).alias("may"), F.col("__safe").alias("safe"))
    listed = rows.groupBy("job_id").agg(F.array_sort(F.collect_list(step_of)).alias("__events"))

    def step(s: Column, e: Column) -> Column:
        kind, claimed = e["event"], s["claimed_at"]
        free = s["held"] & (claimed.isNull() | (claimed <= e["at"] - STALE_AFTER))
        outcome = (
            F.when((kind == "record") & ~e["may"], "refused").when(~e["safe"], "unchanged").when(kind == "record", "recorded")
            .when(kind == "claim", F.when(free, "claimed").otherwise("lost")).when((kind == "release") & s["held"] & claimed.isNotNull(), "released")
            .when((kind == "remove") & s["held"], "removed").otherwise("unchanged")
        )
        null, new = F.lit(None).cast("long"), outcome == "recorded"
        at = F.when(outcome == "claimed", e["at"]).when(outcome.isin("recorded", "released", "removed"), null).otherwise(claimed)
        asked = lambda name: F.when(new, e[name]).otherwise(s[name]).alias(name)
        return F.struct(
            F.when(new, True).when(outcome == "removed", False).otherwise(s["held"]).alias("held"), at.alias("claimed_at"), asked("tree_id"), asked("requested_person_ids"), F.concat(s["outcomes"], F.array(outcome)).alias("outcomes"),
        ).cast(_STATE)

    known = ledger.select("job_id", "claimed_at", "tree_id", "requested_person_ids", F.lit(True).alias("__held"))
    start = F.struct(F.coalesce("__held", F.lit(False)).alias("held"), F.col("claimed_at").cast("long").alias("claimed_at"), "tree_id", "requested_person_ids", F.array().cast("array<string>").alias("outcomes")).cast(_STATE)
    both = known.join(listed, "job_id", "full_outer")
    state = F.aggregate(F.coalesce("__events", F.array().cast(listed.schema["__events"].dataType)), start, step)
    return both.select("job_id", state.alias("__state")).select("job_id", "__state.*")


def entries(queued: DataFrame, claimed: DataFrame) -> DataFrame:
    """All jobs, queued or claimed, with a safe id: one table of job_id, tree_id, requested_person_ids, claimed_at."""
    columns = ["job_id", "tree_id", "requested_person_ids", "claimed_at"]
    rows = queued.withColumn("claimed_at", F.lit(None).cast("long")).select(*columns).unionByName(claimed.select(*columns))
    return rows.where(F.col("job_id").rlike(SAFE_JOB_ID))


def take(ledger: DataFrame, fetched: DataFrame, now: int, limit: int | None, known_trees: DataFrame, only_tree: int | None = None) -> DataFrame:
    """The jobs a drain deals with, and how: ledger (job_id, tree_id, claimed_at) met by fetched (job_id, route: completed, failed, retry).

    Queued jobs and those with a stale claim are up, by id. The limit counts each that has an answer, good or bad; below 1
    none is taken, without one all are. Jobs without an answer, or one that is not done (retry), stay and are not counted. action: failed (a bad answer),
    unknown_tree, release (another tree than the drain's: back to the others), else ingest.
    """
    columns = ["job_id", "tree_id", "action"]
    free = ledger.where(F.col("claimed_at").isNull() | (F.col("claimed_at") <= now - STALE_AFTER)).select("job_id", "tree_id")
    answered = fetched.where("route in ('completed', 'failed')").select("job_id", "route").dropDuplicates(["job_id"])
    trees = known_trees.select("tree_id").distinct().withColumn("__known", F.lit(True))
    rows = free.join(answered, "job_id").join(trees, "tree_id", "left")
    foreign = F.lit(False) if only_tree is None else F.col("tree_id") != only_tree
    action = F.when(F.col("route") == "failed", "failed").when(F.col("__known").isNull(), "unknown_tree").when(foreign, "release").otherwise("ingest")
    rows = rows.withColumn("action", action).select(*columns)
    return rows if limit is None else rows.orderBy("job_id").limit(max(0, limit))


def summary(taken: DataFrame, ledger: DataFrame, now: int) -> DataFrame:
    """One row: ingested, skipped (released), failed among those taken, and how many claims are stale."""
    action = F.col("action")
    counts = taken.agg(F.count_if(action == "ingest").alias("ingested"), F.count_if(action == "release").alias("skipped"), F.count_if(action.isin("failed", "unknown_tree")).alias("failed"))
    stale = ledger.agg(F.count_if(F.col("claimed_at") <= now - STALE_AFTER).alias("stale"))
    return counts.crossJoin(stale)  # one row each
