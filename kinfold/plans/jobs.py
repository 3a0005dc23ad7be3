"""Queries of the job ledger over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..streaming import drain
from . import matching
from .queries import table

# ---- what becomes of jobs: three of each user; every seventh user's ids are not safe; one of the three is queued at first ----
_EVENTS = [
    "CASE WHEN user_id % 7 = 0 THEN 'job ' ELSE 'job-' END || user_id || '-' || (event_id % 3) AS job_id", "event_id % 3 = 0 AS first", "event_id AS seq", "CAST(user_id % 4 AS INT) AS tree",
    "CASE event_type WHEN 'signup' THEN 'record' WHEN 'error' THEN 'release' WHEN 'purchase' THEN 'remove' ELSE 'claim' END AS event",
]


def stm_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after a series of records, claims, releases and removals."""
    rows = table(spark, d, "events").selectExpr(*_EVENTS, "ts").select("*", F.unix_timestamp("ts").alias("at"))
    people = F.array(F.col("seq").cast("string")).alias("requested_person_ids")
    queued = rows.where("first").select("job_id", F.lit(9).alias("tree_id"), F.array(F.lit("")).alias("requested_person_ids"), F.lit(None).cast("long").alias("claimed_at")).dropDuplicates(["job_id"])
    done = ledger.replay(queued, rows.select("job_id", "at", "seq", "event", F.col("tree").alias("tree_id"), people))
    return done.select("job_id", "held", "claimed_at", "tree_id", F.get("requested_person_ids", F.lit(0)).alias("asked"), F.array_join("outcomes", ",").alias("outcomes"))


_OUTCOME = """CASE WHEN r.job_id LIKE 'job %' THEN CASE event WHEN 'record' THEN 'refused' ELSE 'unchanged' END WHEN event = 'record' THEN 'recorded'
  WHEN event = 'claim' THEN CASE WHEN held AND (claimed_at IS NULL OR t - claimed_at >= 3600) THEN 'claimed' ELSE 'lost' END
  WHEN event = 'release' AND held AND claimed_at IS NOT NULL THEN 'released' WHEN event = 'remove' AND held THEN 'removed' ELSE 'unchanged' END"""
STM_LEDGER_SQL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, seq) AS i FROM (SELECT {", ".join(_EVENTS)}, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)),
 r AS (SELECT DISTINCT job_id, 0 AS i, first AS held, CAST(NULL AS BIGINT) AS claimed_at, CASE WHEN first THEN 9 END AS tree_id, CASE WHEN first THEN '' END AS asked, '' AS outcomes FROM e
  UNION ALL SELECT job_id, i, CASE o WHEN 'recorded' THEN true WHEN 'removed' THEN false ELSE held END, CASE WHEN o = 'claimed' THEN t WHEN o IN ('recorded', 'released', 'removed') THEN NULL ELSE claimed_at END,
   CASE WHEN o = 'recorded' THEN tree ELSE tree_id END, CASE WHEN o = 'recorded' THEN CAST(seq AS VARCHAR) ELSE asked END, outcomes || CASE WHEN outcomes = '' THEN '' ELSE ',' END || o
   FROM (SELECT r.job_id, e.i, held, claimed_at, tree_id, asked, outcomes, t, tree, seq, {_OUTCOME} AS o FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1)),
 n AS (SELECT job_id, max(i) AS i FROM r GROUP BY ALL)
 SELECT job_id, held, claimed_at, tree_id, asked, outcomes FROM r JOIN n USING (job_id, i)"""

# ---- what a drain takes ----
NOW, TAKEN = 1_706_659_200, 200
_JOBS = [
    "'j' || o_orderkey AS job_id", "CAST(o_custkey % 4 AS INT) AS tree_id", f"CAST(CASE o_orderkey % 3 WHEN 1 THEN {NOW - 3600} WHEN 2 THEN {NOW - 3599} END AS BIGINT) AS claimed_at",
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'retry' END AS route",
]


def _drain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    jobs = orders.selectExpr(*_JOBS[:3])
    fetched = orders.where("o_orderkey % 5 > 0").selectExpr(_JOBS[0], _JOBS[3])
    return jobs, ledger.take(jobs, fetched, NOW, TAKEN, spark.sql("SELECT explode(array(0, 1, 2)) AS tree_id"), only_tree=1)


def srt_drain(spark: SparkSession, d: str) -> DataFrame:
    """The first TAKEN orders, as jobs with an answer, of a drain of one tree; the limit is the drain's."""
    return _drain(spark, d)[1]


def agg_drain(spark: SparkSession, d: str) -> DataFrame:
    jobs, taken = _drain(spark, d)
    return ledger.summary(taken, jobs, NOW)


SRT_DRAIN_SQL = f"""SELECT job_id, tree_id, CASE WHEN route = 'failed' THEN 'failed' WHEN tree_id = 3 THEN 'unknown_tree' WHEN tree_id <> 1 THEN 'release' ELSE 'ingest' END AS action
 FROM (SELECT {", ".join(_JOBS)} FROM orders WHERE o_orderkey % 5 > 0) WHERE route <> 'retry' AND (claimed_at IS NULL OR {NOW} - claimed_at >= 3600) ORDER BY job_id LIMIT {TAKEN}"""
AGG_DRAIN_SQL = f"""WITH t AS ({SRT_DRAIN_SQL}) SELECT count(*) FILTER (action = 'ingest') AS ingested, count(*) FILTER (action = 'release') AS skipped, count(*) FILTER (action IN ('failed', 'unknown_tree')) AS failed,
 (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 1) AS stale FROM t"""

# ---- a drain: each event is the response of a job about its user, with up to two notices ----
_TREE = "CAST(CASE WHEN event_id % 11 = 0 THEN 9 ELSE user_id % 2 + 1 END AS INT)"
_RESPONSE = [
    "'j' || event_id AS job_id", f"{_TREE} AS tree_id", "array(CAST(user_id AS STRING)) AS requested_person_ids", "'' AS signature", "event_type AS finder_id", "event_id % 97 AS received_at",
    "CAST(user_id AS STRING) AS person", "CASE WHEN value < 60 THEN 'failed' ELSE 'ok' END AS status", "event_id % 3 AS n", "event_id",
]


def _responses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr(*_RESPONSE)
    url = lambda k: F.concat(F.lit("https://a.de/"), ((F.col("event_id") + k) % 4).cast("string"))
    text = lambda x, name: F.lit(x).alias(name)
    notice = lambda k: F.struct(text("Eva Muster", "name"), url(k).alias("url"), text("2024-03-12T10:00:00Z", "fetchedAt"), text("2024-03-09", "death"))
    notices = F.slice(F.array(notice(0), notice(1)), F.lit(1), F.col("n").cast("int"))
    portal = F.struct(text("p", "portal"), F.col("status"), F.col("n").cast("int").alias("noticeCount"))
    result = F.struct(notices.alias("notices"), F.array(portal).alias("coverage"))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.col("job_id").alias("jobId"), F.when(F.col("event_id") % 13 == 0, "queued").otherwise("done").alias("state"), F.create_map("person", result).alias("results"))
    return rows.select("job_id", "tree_id", "requested_person_ids", "signature", "finder_id", "received_at", F.to_json(body).alias("body"))


def _held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """People of two trees, and the trees."""
    held = matching.people(spark, d).where("CAST(person_id AS INT) % 8 > 0")
    held = held.withColumn("tree_id", (F.col("person_id").cast("int") % 2 + 1).cast("int")).withColumn("signature", F.concat(F.lit("s"), "person_id"))
    return held, spark.sql("SELECT explode(array(1, 2)) AS tree_id")


def drained(spark: SparkSession, d: str) -> drain.Drained:
    """All events in one drain."""
    held, trees = _held(spark, d)
    return drain.drain_tables(_responses(spark, d), held, None, trees)


def stm_drain(spark: SparkSession, d: str) -> DataFrame:
    """The keyed tables after two drains of all events, one for the even and one for the odd ones: matches with origin, coverage, and what is remembered."""
    (held, trees), rows = _held(spark, d), _responses(spark, d)
    state = None
    for odd in (0, 1):
        state = drain.drain_tables(rows.where(F.substring("job_id", 2, 20).cast("long") % 2 == odd), held, state, trees).state
    who, none = ("tree_id", "person_id"), F.lit(None).cast("string")
    matches = state["matches"].select(F.lit("match").alias("what"), *who, F.col("origin").alias("finder_id"), F.col("url").alias("key"), "status", F.lit(None).cast("long").alias("at"))
    portals = state["coverage"].select(F.lit("coverage").alias("what"), *who, "finder_id", F.col("job_id").alias("key"), F.col("portals")[0]["status"].alias("status"), F.col("portals")[0]["notice_count"].alias("at"))
    memory = state["memory"].select(F.lit("memory").alias("what"), *who, "finder_id", F.col("signature").alias("key"), none.alias("status"), F.col("recorded_at").alias("at"))
    return matches.union(portals).union(memory)


# Turns: the even events by arrival and job id, then the odd ones.
TURNS_SQL = f"""e AS (SELECT {", ".join(_RESPONSE).replace("STRING", "VARCHAR").replace("array(CAST(user_id AS VARCHAR))", "''")} FROM events),
 j AS (SELECT *, user_ok AS held, row_number() OVER (ORDER BY event_id % 2, received_at, job_id) AS turn FROM (SELECT *, CAST(person AS BIGINT) % 8 > 0 AND CAST(person AS BIGINT) IN (SELECT c_custkey FROM customer) AS user_ok FROM e)
   WHERE tree_id <> 9 AND event_id % 13 > 0),
 u AS (SELECT turn, tree_id, person, finder_id, k, 'https://a.de/' || ((event_id + k) % 4) AS url FROM j, (VALUES (0), (1)) v(k) WHERE held AND k < n)"""
STM_DRAIN_SQL = f"""WITH {TURNS_SQL},
 m AS (SELECT tree_id, person, url, arg_max(finder_id, turn * 2 + k) AS origin FROM u GROUP BY ALL),
 c AS (SELECT tree_id, person, finder_id, arg_max(job_id, turn) AS job_id, arg_max(status, turn) AS status, arg_max(n, turn) AS n FROM j GROUP BY ALL),
 f AS (SELECT tree_id, person, max(turn) AS found FROM j WHERE status = 'ok' AND n > 0 GROUP BY ALL),
 r AS (SELECT tree_id, person, finder_id, arg_max(received_at, turn) AS received_at FROM j LEFT JOIN f USING (tree_id, person) WHERE held AND status = 'ok' AND n = 0 AND turn > coalesce(found, 0) GROUP BY ALL)
 SELECT 'match' AS what, tree_id, person AS person_id, origin AS finder_id, url AS key, 'pending' AS status, CAST(NULL AS BIGINT) AS at FROM m
 UNION ALL SELECT 'coverage', tree_id, person, finder_id, job_id, status, n FROM c
 UNION ALL SELECT 'memory', tree_id, person, finder_id, 's' || person, NULL, received_at FROM r"""

QUERIES = {"stm_ledger": stm_ledger, "srt_drain": srt_drain, "agg_drain": agg_drain, "stm_drain": stm_drain}
ORACLE_SQL = {"stm_ledger": STM_LEDGER_SQL, "srt_drain": SRT_DRAIN_SQL, "agg_drain": AGG_DRAIN_SQL, "stm_drain": STM_DRAIN_SQL}
