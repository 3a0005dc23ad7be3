"""Queries of the interval join, of pages by key, of remembered searches and of drains by finder, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..functions import text as T
from ..operators import counting, intervals, stores
from ..sources import bucketed, documents
from ..sources.folders import scratch
from ..sources.forms import Forms
from ..sources.pages import Pages, write_pages
from ..streaming import fan_out, searches
from . import jobs
from .queries import _STATUS_SQL, _TOKENS_SQL as TOKENS_SQL, JN_CANDIDATES_SQL, PHN_GROUPS_SQL, SRT_PAGE_SQL, STRIPPED_SQL, open_matches, table

# ---- ranges: an order's is open at its end for one in fifty, a line item's at its begin for one in ninety, and empty for some ----
_ORDER_RANGE = [
    "o_orderkey", "o_custkey AS part", "CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS lo",
    "CAST(CASE WHEN o_orderkey % 50 > 0 THEN date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 40 * (o_orderkey % 7) END AS INT) AS hi",
]
_ITEM_RANGE = [
    "l_orderkey", "l_linenumber", "l_partkey AS part", "CAST(CASE WHEN l_orderkey % 90 > 0 THEN date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) END AS INT) AS lo",
    "CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_orderkey % 30 AS INT) - 2 AS INT) AS hi",
]


def _spark(exprs: list[str]) -> list[str]:
    return [e.replace("date_diff('day', DATE", "datediff(DAY, DATE") for e in exprs]


def jn_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Orders and line items of the part of a customer's number whose time ranges overlap."""
    orders, items = table(spark, d, "orders").selectExpr(*_spark(_ORDER_RANGE)), table(spark, d, "lineitem").selectExpr(*_spark(_ITEM_RANGE))
    rows = intervals.overlap_join(orders, items, on=["part"])
    return rows.select("l.o_orderkey", "r.l_orderkey", "r.l_linenumber", F.col("l.lo").alias("o_lo"), F.col("l.hi").alias("o_hi"), F.col("r.lo").alias("l_lo"), F.col("r.hi").alias("l_hi"))


JN_OVERLAPS_SQL = f"""WITH o AS (SELECT {", ".join(_ORDER_RANGE)} FROM orders), l AS (SELECT {", ".join(_ITEM_RANGE)} FROM lineitem)
 SELECT o_orderkey, l_orderkey, l_linenumber, o.lo AS o_lo, o.hi AS o_hi, l.lo AS l_lo, l.hi AS l_hi FROM o JOIN l ON o.part = l.part AND coalesce(o.lo, -999999) <= coalesce(l.hi, 999999) AND coalesce(l.lo, -999999) <= coalesce(o.hi, 999999)
 WHERE (o.lo IS NULL OR o.hi IS NULL OR o.lo <= o.hi) AND (l.lo IS NULL OR l.hi IS NULL OR l.lo <= l.hi)"""

# ---- pages ----
_DEEP = 40


def srt_worklist_deep(spark: SparkSession, d: str) -> DataFrame:
    """A page far down the list of open matches, read from parts in order."""
    path = scratch(spark, "pages")
    write_pages(open_matches(spark, d), [F.desc("score"), F.asc("person_id"), F.asc("o_orderkey")], path, parts=16)
    return Pages.open(spark, path).page(_DEEP)


SRT_DEEP_SQL = f"WITH a AS ({SRT_PAGE_SQL.split(' LIMIT ')[0]}), n AS (SELECT count(*) AS n FROM a), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, person_id, o_orderkey) AS k FROM a) SELECT person_id, o_orderkey, status, score FROM r, n WHERE (k - 1) // 50 = least({_DEEP} - 1, (n - 1) // 50)"

# ---- scans that stop: the first customers of a balance, in order of id, of a table in order ----
_CAP = 100
_RICH = "c_acctbal > 2000"


def agg_preview(spark: SparkSession, d: str) -> DataFrame:
    """How many customers there are of each kind, as far as a preview counts."""
    rows = table(spark, d, "customer")
    one = lambda when, kind: counting.preview(rows.where(when), _CAP).select(F.lit(kind).alias("kind"), "n", "capped")
    return one(_RICH, "rich").union(one("c_acctbal > 9990", "richest")).union(one("c_custkey < 0", "none"))


AGG_PREVIEW_SQL = f"""SELECT kind, least(n, {_CAP}) AS n, n > {_CAP} AS capped FROM (SELECT 'rich' AS kind, count(*) FILTER ({_RICH}) AS n FROM customer UNION ALL SELECT 'richest', count(*) FILTER (c_acctbal > 9990) FROM customer UNION ALL SELECT 'none', 0)"""


def src_first(spark: SparkSession, d: str) -> DataFrame:
    """The first customers that pass a filter, by the bytes of their ids, without reading those beyond."""
    path = scratch(spark, "people")
    people = table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS person_id", "c_acctbal")
    write_pages(people, [F.asc("person_id")], path, parts=32)
    return counting.first_that(Pages.open(spark, path), lambda rows: rows.where("c_acctbal > 2000"), [F.asc("person_id")], _CAP)[0]


SRC_FIRST_SQL = f"SELECT CAST(c_custkey AS VARCHAR) AS person_id, c_acctbal FROM customer WHERE {_RICH} ORDER BY person_id LIMIT {_CAP}"


# ---- documents ----
def src_documents(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as documents, and read back: all of some people, found by folder."""
    root = scratch(spark, "documents")
    raw = F.to_json(F.struct(F.concat(F.lit("P"), (F.col("s_suppkey") % 40).cast("string")).alias("personId"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    rows = table(spark, d, "supplier").select(F.concat(F.lit("P"), (F.col("s_suppkey") % 40).cast("string")).alias("person_id"), F.concat(F.lit("k/"), F.col("s_suppkey").cast("string")).alias("row_key"), raw.alias("raw"))
    documents.write(rows, root)
    got = documents.read(spark, root, folders_per_task=8)
    return got.select("person_id", "row_key", "size", F.get_json_object("raw", "$.name").alias("name"), "error")


SRC_DOCUMENTS_SQL = """SELECT 'P' || s_suppkey % 40 AS person_id, 'k/' || s_suppkey AS row_key, CAST(strlen('{"personId":"P' || s_suppkey % 40 || '","name":"' || s_name || '","nation":' || s_nationkey || '}') AS BIGINT) AS size, s_name AS name, CAST(NULL AS VARCHAR) AS error FROM supplier"""

# ---- bucketed tables ----
def jn_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of jn_candidates with the number of their undecided matches, from tables bucketed by person: joins and counts without a shuffle."""
    orders, run = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), uuid.uuid4().hex[:12]
    made = {
        "people": table(spark, d, "customer").select("c_custkey", "c_name"),
        "facts": orders.select("c_custkey", F.year("o_orderdate").alias("born"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300_000)).alias("death")),
        "matches": orders.select("c_custkey", F.expr(_STATUS_SQL).alias("status")),
    }
    people, facts, matches = (bucketed.write_bucketed(df, f"kinfold_{t}_{run}", ["c_custkey"], 8) for t, df in made.items())
    found = stores.select_candidates(people, facts.where("death"), facts, "c_custkey", "born", 2085, 90)
    n = matches.where("status in ('pending', 'uncertain')").groupBy("c_custkey").agg(F.count("*").alias("n_open"))
    # Hints keep both sides where they lie: a table that grows must not be sent to all tasks on the strength of its size today.
    return found.join(n.hint("merge"), "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n_open", F.lit(0)).alias("n_open"))


JN_BUCKETED_SQL = f"""WITH a AS ({JN_CANDIDATES_SQL}), n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE {_STATUS_SQL} IN ('pending', 'uncertain') GROUP BY o_custkey)
 SELECT c_custkey, c_name, coalesce(n, 0) AS n_open FROM a LEFT JOIN n ON o_custkey = c_custkey"""

# ---- forms of words: each distinct one once, in a dictionary that a second batch only extends; codes by encoders of a name ----
def _words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \t\n]+")).alias("token"))
    return words.where("token <> ''")


def phn_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents by phonetic code, through a stored dictionary: the odd documents' words first, then what the even ones add."""
    forms, words = Forms(spark, scratch(spark, "forms"), {"code": T.phonetic}), _words(spark, d)
    for odd in (1, 0):
        forms.extend(words.where(F.col("doc_id") % 2 == odd), "token")
    counted = words.groupBy("token").agg(F.count("*").alias("n"))
    return forms.join(counted, "token").groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


def phn_encoders(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents by the codes of all encoders, in SQL text."""
    for name in registry.ENCODERS:
        registry.register(spark, name)
    counted = _words(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    one = lambda name: counted.selectExpr(f"'{name}' AS encoder", f"kinfold_encode_{name}(token) AS code", "n")
    return one("cologne").union(one("skeleton")).groupBy("encoder", "code").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


PHN_ENCODERS_SQL = f"""SELECT 'cologne' AS encoder, * FROM ({PHN_GROUPS_SQL}) UNION ALL
 SELECT 'skeleton', s[1:1] || regexp_replace(s[2:], '[aeiouy]', '', 'g') AS code, CAST(sum(n) AS BIGINT), count(*) FROM (WITH {TOKENS_SQL} SELECT {STRIPPED_SQL} AS s, n FROM t) GROUP BY 2"""

# ---- remembered searches: half of the events ask, the others are finds and searches in vain ----
_SEARCH = [
    "CAST(user_id % 3 AS INT) AS tree_id", "CAST(user_id AS STRING) AS person_id", "event_type AS finder_id", "CASE WHEN event_id % 2 = 0 THEN 'ask' WHEN value > 350 THEN 'find' ELSE 'miss' END AS kind",
    "'s' || event_id % 5 % 2 AS signature", "event_id * 500 AS at", "event_id AS seq",
]


def stm_memory(spark: SparkSession, d: str) -> DataFrame:
    """Which searches need not be made: the last one was in vain, lately, of the same signature, and nothing was found since."""
    return searches.verdicts(table(spark, d, "events").selectExpr(*_SEARCH), ttl=400_000)


STM_MEMORY_SQL = f"""WITH e AS (SELECT {", ".join(_SEARCH).replace("STRING", "VARCHAR").replace(" AS at", ' AS "at"')} FROM events),
 x AS (SELECT *, arg_max(signature, seq) FILTER (kind = 'miss') OVER f AS s, max(seq) FILTER (kind = 'miss') OVER f AS m, max(seq) FILTER (kind = 'find') OVER (PARTITION BY tree_id, person_id ORDER BY seq) AS found
  FROM e WINDOW f AS (PARTITION BY tree_id, person_id, finder_id ORDER BY seq))
 SELECT tree_id, person_id, finder_id, "at", seq, CASE WHEN m IS NOT NULL AND (found IS NULL OR m > found) AND s = signature AND "at" - m * 500 < 400000 THEN 'suppressed' ELSE 'searched' END AS outcome FROM x WHERE kind = 'ask'"""


# ---- drains by finder ----
def agg_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """What the drains of all finders have done, one by one and together."""
    return fan_out.by_finder(jobs.drained(spark, d).jobs)


AGG_FAN_OUT_SQL = f"""WITH {jobs.TURNS_SQL},
 c AS (SELECT job_id, count(DISTINCT url) AS n FROM u JOIN j USING (turn) GROUP BY job_id),
 a AS (SELECT e.finder_id, e.event_id % 13 > 0 AS answered, tree_id = 9 AS unknown, coalesce(c.n, 0) AS n FROM e LEFT JOIN c USING (job_id))
 SELECT finder_id, count(*) FILTER (answered AND NOT unknown) AS ingested, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (answered AND unknown) AS failed, CAST(sum(n) AS BIGINT) AS stored, grouping(finder_id) = 1 AS total FROM a GROUP BY ROLLUP (finder_id)"""

QUERIES = {"jn_overlaps": jn_overlaps, "agg_preview": agg_preview, "src_first": src_first, "src_documents": src_documents, "jn_bucketed": jn_bucketed, "phn_dictionary": phn_dictionary, "phn_encoders": phn_encoders, "srt_worklist_deep": srt_worklist_deep, "stm_memory": stm_memory, "agg_fan_out": agg_fan_out}
ORACLE_SQL = {"jn_overlaps": JN_OVERLAPS_SQL, "agg_preview": AGG_PREVIEW_SQL, "src_first": SRC_FIRST_SQL, "src_documents": SRC_DOCUMENTS_SQL, "jn_bucketed": JN_BUCKETED_SQL, "phn_dictionary": PHN_GROUPS_SQL, "phn_encoders": PHN_ENCODERS_SQL, "srt_worklist_deep": SRT_DEEP_SQL, "stm_memory": STM_MEMORY_SQL, "agg_fan_out": AGG_FAN_OUT_SQL}
