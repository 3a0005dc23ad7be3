"""Queries of validation, review and write-back over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review, stores
from ..sources import responses
from .tables import spread, table

FOLDED = ["Elise", "Hans", "Käthe", "Kaethe", "Kathe", "Müller", "Mueller", "Weiß", "Weiss"]


# ---- responses: one is derived from each event, with every kind of fault ----
_BODY = """concat('{"schemaVersion":', CASE WHEN event_id % 11 = 0 THEN '"1"' ELSE '1' END, ',"jobId":"', CASE WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END,
 '","state":"', CASE event_id % 17 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'lost' ELSE 'done' END, '","results":', CASE WHEN event_id % 23 = 0 THEN '[1]' ELSE concat('{"', CASE WHEN event_id % 5 = 0 THEN '9' ELSE '1' END,
 '":{"notices":[{"name":"', CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'Anna Alt' END, '","noticeType":"', CASE event_id % 7 WHEN 1 THEN 'obituary' WHEN 2 THEN 'death_notice' WHEN 3 THEN 'funeral_notice' WHEN 4 THEN 'grave_memorial' WHEN 5 THEN 'cemetery_record' ELSE 'memorial' END, '","age":', CASE WHEN event_id % 2 = 0 THEN '86' ELSE '"86"' END, ',"url":"', CASE WHEN event_id % 7 = 0 THEN 'ftp' ELSE 'https' END, '://a.de/', CAST(event_id AS STRING),
 '","fetchedAt":"2024-', CASE WHEN event_id % 29 = 0 THEN '02-30' ELSE '03-12' END, 'T10:00:00Z"}],"coverage":[{"portal":"p","status":"ok","noticeCount":', CASE WHEN event_id % 19 = 0 THEN '-1' ELSE '1' END, '}]}}') END, '}')"""


def _responses(spark: SparkSession, d: str) -> responses.Validated:
    events = spread(table(spark, d, "events").select("event_id"), "event_id")
    rows = events.selectExpr("event_id", "CAST(event_id AS STRING) AS job_id", "array('1') AS requested_person_ids", f"{_BODY} AS body")
    return responses.validate(rows)


def val_responses(spark: SparkSession, d: str) -> DataFrame:
    """Route and reason of every response."""
    return _responses(spark, d).jobs.select("event_id", "route", "reason")


_REASON = """CASE WHEN event_id % 17 = 2 THEN 'state_invalid' WHEN event_id % 17 = 0 THEN 'finder_failed' WHEN event_id % 17 = 1 THEN 'not_done' WHEN event_id % 11 = 0 THEN 'schema_version' WHEN event_id % 13 = 0 THEN 'job_id'
 WHEN event_id % 23 = 0 THEN 'results_not_object' WHEN event_id % 5 = 0 THEN 'person_not_requested' WHEN event_id % 7 = 0 THEN 'url_scheme' WHEN event_id % 29 = 0 THEN 'fetched_at' WHEN event_id % 19 = 0 THEN 'coverage_count' END"""
VAL_RESPONSES_SQL = f"WITH r AS (SELECT event_id, {_REASON} AS reason FROM events) SELECT event_id, CASE WHEN reason IS NULL THEN 'completed' WHEN reason = 'not_done' THEN 'retry' ELSE 'failed' END AS route, reason FROM r"


def val_notices(spark: SparkSession, d: str) -> DataFrame:
    """Notices of the accepted responses; those without a name are gone."""
    return _responses(spark, d).notices.select(F.col("job_id").cast("long").alias("event_id"), "name", "notice_type", "age", "row_key", "disposition", F.col("parsed_name.surname").alias("surname"))


VAL_NOTICES_SQL = f"SELECT event_id, 'Anna Alt' AS name, CASE event_id % 7 WHEN 2 THEN 'death_notice' WHEN 3 THEN 'funeral_notice' WHEN 4 THEN 'grave_memorial' WHEN 5 THEN 'cemetery_record' ELSE 'obituary' END AS notice_type, CASE WHEN event_id % 2 = 0 THEN CAST(86 AS BIGINT) END AS age, sha256('https://a.de/' || event_id) AS row_key, 'burial' AS disposition, 'Alt' AS surname FROM events WHERE ({_REASON}) IS NULL AND event_id % 3 <> 0"


# ---- gate, write-back, revert ----
_ISO = "CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN concat(CAST(year(o_orderdate) AS STRING), '-02-30') END"


def flt_confirm_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each match may be confirmed, and if not, why."""
    gate = review.confirm_gate(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 7 == 0, F.col("iso"))
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_ISO} AS iso").select("o_orderkey", gate.alias("reason"))


FLT_CONFIRM_GATE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'hard_conflict' WHEN o_orderkey % 7 = 0 THEN 'tree_already_has_death_date' WHEN o_orderkey % 3 > 0 THEN 'no_exact_death_date' END AS reason FROM orders"


def snk_revert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.array(F.lit("f1"), F.lit("f2")).alias("w"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("f2"), F.lit("f1"), F.lit("f9"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("f1"))).alias("x"))
    return rows.select("o_orderkey", review.revert_verdict(F.col("w"), F.col("x"), F.col("o_orderkey") % 5 == 0).alias("verdict"))


SNK_REVERT_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'reverted' ELSE 'facts_missing' END AS verdict FROM orders"


# ---- worklist ----
def snk_bulk_reject(spark: SparkSession, d: str) -> DataFrame:
    """Orders as matches; every fourth is named, some twice, some under a wrong person or without a colon."""
    orders = table(spark, d, "orders")
    status = "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'uncertain' ELSE 'pending' END AS status"
    rows = orders.selectExpr("CAST(o_custkey AS STRING) AS person_id", "CAST(o_orderkey AS STRING) AS row_key", status)
    named = orders.where("o_orderkey % 4 = 0").selectExpr("explode(array(concat(o_custkey, ':', o_orderkey), concat(o_custkey, ':', o_orderkey), concat(o_custkey + 1, ':', o_orderkey), CAST(o_orderkey AS STRING))) AS token")
    return review.bulk_reject(rows, named)


SNK_BULK_REJECT_SQL = "SELECT CAST(o_custkey AS VARCHAR) AS person_id, CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN o_orderkey % 4 = 0 THEN 'rejected' WHEN o_orderstatus = 'P' THEN 'uncertain' ELSE 'pending' END AS status FROM orders"

_FAILING = "CASE WHEN value < 60 THEN 'failed' ELSE 'ok' END"


def srt_retry_list(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 people without any match whose search a portal failed, with their number."""
    coverage = table(spark, d, "events").selectExpr("user_id", f"{_FAILING} AS status", "CAST(NULL AS INT) AS notice_count")
    outcomes = stores.search_outcome(coverage, ["user_id"]).selectExpr("user_id", "outcome", "concat('name ', user_id % 7) AS name")
    matches = table(spark, d, "orders").where("o_custkey % 3 = 0").selectExpr("o_custkey AS user_id")
    return review.retry_list(outcomes, matches, key="user_id").select("user_id", "name", "total")


SRT_RETRY_LIST_SQL = f"""WITH p AS (SELECT user_id, 'name ' || (user_id % 7) AS name FROM events WHERE {_FAILING} = 'failed' AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0) GROUP BY user_id)
 SELECT user_id, name, (SELECT count(*) FROM p) AS total FROM p ORDER BY name, user_id LIMIT 50"""


def src_latest_change(spark: SparkSession, d: str) -> DataFrame:
    return review.latest_change(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


SRC_LATEST_CHANGE_SQL = "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id"


def agg_origins(spark: SparkSession, d: str) -> DataFrame:
    rows = review.has_many_origins(table(spark, d, "events").select("user_id", F.expr("CASE WHEN value > 50 THEN event_type END").alias("origin")), ["user_id"], "origin")
    return rows.select("user_id", "many_origins", F.array_join("origins", ",").alias("origins"))


AGG_ORIGINS_SQL = "SELECT user_id, count(DISTINCT event_type) FILTER (value > 50) > 1 AS many_origins, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (value > 50)), ','), '') AS origins FROM events GROUP BY user_id"


# ---- filters and signatures ----
def flt_people(spark: SparkSession, d: str) -> DataFrame:
    """Age window and strict settings of each customer."""
    rows = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 11 > 0 THEN CAST(1900 + c_custkey % 130 AS INT) END AS born", "CASE c_custkey % 5 WHEN 0 THEN ' 7' WHEN 1 THEN '1234567890' WHEN 2 THEN NULL ELSE CAST(c_custkey AS STRING) END AS raw")
    return rows.select("c_custkey", review.in_age_window(F.col("born"), 2024, 90, 120).alias("in_window"), review.in_age_window(F.col("born"), 2024, 90, None, True).alias("open_window"), review.strict_int(F.col("raw"), 10, 100, 50).alias("setting"))


FLT_PEOPLE_SQL = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN 1900 + c_custkey % 130 END AS born FROM customer)
 SELECT c_custkey, coalesce(2024 - born BETWEEN 90 AND 120, false) AS in_window, coalesce(2024 - born >= 90, true) AS open_window, CAST(CASE WHEN c_custkey % 5 <= 2 THEN 50 ELSE least(100, greatest(10, c_custkey)) END AS INT) AS setting FROM c"""


def _fold_sql(c: str) -> str:
    return f"regexp_replace(lower(replace(replace(replace({c}, 'ä', 'a'), 'ü', 'u'), 'ß', 'ss')), '([aou])e', '\\1', 'g')"


def str_signature(spark: SparkSession, d: str) -> DataFrame:
    """People of each part by search signature, byte for byte: how many have it, and the first; the order of places plays no part."""
    name = lambda n: F.element_at(F.array(*(F.lit(x) for x in FOLDED)), (F.floor(F.col("p_partkey") / n) % len(FOLDED) + 1).cast("int"))
    places = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Bonn"), F.lit("KÖLN"))).otherwise(F.array(F.lit("Koeln"), F.lit("bonn"), F.lit("Köln")))
    none = F.lit(None).cast("string")
    rows = table(spark, d, "part").select("p_partkey", review.search_signature(F.array(name(1)), name(9), none, (F.lit(1900) + F.col("p_size")).cast("int"), places, none).alias("signature"))
    return rows.groupBy("signature").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))


_NAMED = lambda n: f"([{', '.join(repr(x) for x in FOLDED)}])[1 + p_partkey // {n} % {len(FOLDED)}]"
STR_SIGNATURE_SQL = f"""SELECT sha256('{{"given":["' || {_fold_sql(_NAMED(1))} || '"],"surname":"' || {_fold_sql(_NAMED(9))} || '","birthSurname":"","birthYear":' || (1900 + p_size) || ',"places":["bonn","koln"],"region":""}}') AS signature, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1"""


def stm_claims(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by the state of their claim at one moment."""
    jobs = table(spark, d, "events").select(F.when(F.col("event_id") % 3 > 0, F.unix_timestamp("ts")).alias("claimed_at"))
    return review.claims(jobs, 1_706_659_200).groupBy("state").agg(F.count("*").alias("n"))


STM_CLAIMS_SQL = "SELECT CASE WHEN event_id % 3 = 0 THEN 'queued' WHEN floor(epoch(ts)) <= 1706659200 - 3600 THEN 'stale' ELSE 'claimed' END AS state, count(*) AS n FROM events GROUP BY state"

QUERIES = {
    "val_responses": val_responses, "val_notices": val_notices, "flt_confirm_gate": flt_confirm_gate, "snk_revert": snk_revert, "snk_bulk_reject": snk_bulk_reject, "srt_retry_list": srt_retry_list,
    "src_latest_change": src_latest_change, "agg_origins": agg_origins, "flt_people": flt_people, "str_signature": str_signature, "stm_claims": stm_claims,
}
ORACLE_SQL = {
    "val_responses": VAL_RESPONSES_SQL, "val_notices": VAL_NOTICES_SQL, "flt_confirm_gate": FLT_CONFIRM_GATE_SQL, "snk_revert": SNK_REVERT_SQL, "snk_bulk_reject": SNK_BULK_REJECT_SQL, "srt_retry_list": SRT_RETRY_LIST_SQL,
    "src_latest_change": SRC_LATEST_CHANGE_SQL, "agg_origins": AGG_ORIGINS_SQL, "flt_people": FLT_PEOPLE_SQL, "str_signature": STR_SIGNATURE_SQL, "stm_claims": STM_CLAIMS_SQL,
}
