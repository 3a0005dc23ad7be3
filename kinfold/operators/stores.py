"""Stored matches, coverage and negative memory as keyed tables, and the life cycle of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("confirmed", "rejected")


def next_status(status: Column, event: Column) -> Column:
    """The status after an event; null status is a missing row. An event that does not apply leaves it as it is.

    upsert makes a pending row of anything not terminal; reject also makes a row; uncertain and confirm need one; revert
    takes back a confirmation.
    """
    open_ = status.isin("pending", "uncertain")
    return (
        F.when((event == "upsert") & (status.isNull() | open_), "pending")
        .when((event == "reject") & (status.isNull() | open_), "rejected")
        .when((event == "uncertain") & open_, "uncertain")
        .when((event == "confirm") & open_, "confirmed")
        .when((event == "revert") & (status == "confirmed"), "pending")
        .otherwise(status)
    )


def replay(events: DataFrame, key: list[str], order: list[str], event: str) -> DataFrame:
    """key, status after all events of each key in order, n_events. A key's events are an array; its length is a match's history, not the table."""
    rows = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("__event")))).alias("__events"))
    status = F.aggregate("__events", F.lit(None).cast("string"), lambda s, e: next_status(s, e["__event"]))
    return rows.select(*key, status.alias("status"), F.size("__events").alias("n_events"))


def upsert_pending(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored merged with new rows of the same columns: terminal rows stay, others are overwritten and pending again."""
    columns = [c for c in stored.columns if c not in key]
    both = stored.alias("o").join(new.alias("n"), key, "full_outer")
    keep = F.col("o.status").isin(*TERMINAL) | F.col("n.status").isNull()
    return both.select(*key, *(F.when(F.coalesce(keep, F.lit(False)), F.col(f"o.{c}")).otherwise(F.lit("pending") if c == "status" else F.col(f"n.{c}")).alias(c) for c in columns))


def last_wins(rows: DataFrame, key: list[str], seq: str | list[str]) -> DataFrame:
    """One row a key, that of the highest seq (of several columns: the first that differs decides); aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    by = F.col(seq) if isinstance(seq, str) else F.struct(*seq)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("__last")).select(*key, "__last.*")


def search_outcome(coverage: DataFrame, key: list[str], status: str = "status", count: str = "notice_count") -> DataFrame:
    """key, outcome: found, portal_failed, no_notices or skipped."""
    ok, failed = F.col(status) == "ok", F.col(status) == "failed"
    rows = coverage.groupBy(*key).agg(F.sum(F.when(ok, F.coalesce(F.col(count), F.lit(0)))).alias("n"), F.bool_or(failed).alias("failed"), F.bool_or(ok).alias("ok"))
    return rows.select(*key, F.when(F.col("n") > 0, "found").when(F.col("failed"), "portal_failed").when(F.col("ok"), "no_notices").otherwise("skipped").alias("outcome"))


def merge_coverage(coverage: DataFrame, key: list[str], portal: str = "portal", status: str = "status", count: str = "notice_count", message: str = "message", seq: str = "seq") -> DataFrame:
    """One row by key and portal: ok before failed before skipped, the most notices, the first message of a failure."""
    ok, failed = F.col(status) == "ok", F.col(status) == "failed"
    rows = coverage.groupBy(*key, portal).agg(
        F.bool_or(ok).alias("__ok"), F.bool_or(failed).alias("__failed"), F.max(F.when(ok, F.col(count))).alias("__n"),
        F.min_by(F.when(failed, F.col(message)), F.when(failed & F.col(message).isNotNull(), F.col(seq))).alias("__message"),
    )
    return rows.select(*key, portal, F.when(F.col("__ok"), "ok").when(F.col("__failed"), "failed").otherwise("skipped").alias(status), F.when(F.col("__ok"), F.col("__n")).alias(count), F.when(~F.col("__ok") & F.col("__failed"), F.col("__message")).alias(message))


def suppressed(memory: DataFrame, key: list[str], signature: str, recorded_at: str, now: int, ttl: int = 2_592_000) -> DataFrame:
    """Distinct key, signature that a search need not be repeated for: recorded less than ttl seconds ago."""
    return memory.where(F.lit(now) - F.col(recorded_at) < ttl).select(*key, signature).distinct()


def worklist_counts(matches: DataFrame, status: str = "status") -> DataFrame:
    c = F.col(status)
    return matches.agg(F.count("*").alias("total"), F.count_if(c.isin("pending", "uncertain")).alias("open"), *(F.count_if(c == s).alias(s) for s in ("confirmed", "rejected", "uncertain")))


def page(rows: DataFrame, by: list[Column], number: int, size: int = 50) -> DataFrame:
    """A page of rows in order; numbers out of range are brought into it. Only as many rows as the page reaches are sorted out."""
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(*by).offset((min(max(1, number), last) - 1) * size).limit(size)


def select_candidates(people: DataFrame, deaths: DataFrame, births: DataFrame, key: str, born: str, ref_year: int, min_age: int = 90) -> DataFrame:
    """people without any death who have a birth of a year up to ref_year - min_age."""
    old = births.where((F.col(born) > 0) & (F.col(born) <= ref_year - min_age))
    return people.join(deaths.select(key), key, "left_anti").join(old.select(key), key, "left_semi")


_STATE = "struct<status:string,reason:string,write_back:string,outcomes:array<string>>"


def decide(stored: DataFrame, events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """stored (key, status, reason, write_back and more) after events (key, event, reason, write_back) in order, with outcomes, one for each event.

    upsert: stored (pending, without reason and write-back), or kept where the row is decided. reject: rejected, a row being made if
    there is none; unchanged for the same reason; refused if confirmed. uncertain: uncertain; missing; unchanged; refused
    if decided. confirm: confirmed, its reason staying; missing; unchanged; refused if rejected. revert: pending,
    without reason and write-back; refused if not confirmed. Keys without a row that no event makes have a null status.
    Columns of stored that are not named here stay. A key's events are an array, its history.
    """
    null = F.lit(None).cast("string")
    listed = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, "event", F.col("reason").alias("why"), F.col("write_back").alias("wb")))).alias("__events"))

    def step(s: Column, e: Column) -> Column:
        row, kind = s["status"], e["event"]
        decided, same = row.isin(*TERMINAL), s["reason"].eqNullSafe(e["why"])
        outcome = (
            F.when(kind == "upsert", F.when(F.coalesce(decided, F.lit(False)), "kept").otherwise("stored"))
            .when(kind == "reject", F.when(row == "confirmed", "refused").when((row == "rejected") & same, "unchanged").otherwise("rejected"))
            .when(kind == "uncertain", F.when(row.isNull(), "missing").when(decided, "refused").when((row == "uncertain") & same, "unchanged").otherwise("uncertain"))
            .when(kind == "confirm", F.when(row.isNull(), "missing").when(row == "confirmed", "unchanged").when(row == "rejected", "refused").otherwise("confirmed"))
            .when(kind == "revert", F.when(row == "confirmed", "reverted").otherwise("refused")).otherwise("unknown")
        )
        status = F.when(outcome.isin("stored", "reverted"), "pending").when(outcome.isin("rejected", "uncertain", "confirmed"), outcome).otherwise(row)
        reason = F.when(outcome.isin("stored", "reverted"), null).when(outcome.isin("rejected", "uncertain"), e["why"]).otherwise(s["reason"])
        written = F.when(outcome.isin("stored", "reverted"), null).when(outcome == "confirmed", e["wb"]).otherwise(s["write_back"])
        return F.struct(status.alias("status"), reason.alias("reason"), written.alias("write_back"), F.concat(s["outcomes"], F.array(outcome)).alias("outcomes")).cast(_STATE)

    start = F.struct("status", "reason", "write_back", F.array().cast("array<string>").alias("outcomes")).cast(_STATE)
    rows = stored.join(listed, key, "full_outer").withColumn("__state", F.aggregate(F.coalesce("__events", F.array().cast(listed.schema["__events"].dataType)), start, step))
    return rows.select(*key, *(F.col(c) for c in stored.columns if c not in (*key, "status", "reason", "write_back")), "__state.*")
