"""Queries of the drain's and the enqueuer's steps over the driver's tables, with DuckDB SQL: a customer is a person, an order a notice of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from ..operators import enqueue, ingest, ranking, scoring, stores, worklist
from . import queries as Q
from .queries import FAMILY, GIVEN, pick, table

_fix = lambda e: re.sub(r"// (\d+)", r"div \1", e)

# ---- people and notices ----
_G1, _F1, _B1, _M1 = pick(GIVEN, "c_custkey"), pick(FAMILY, "c_custkey"), pick([*FAMILY, None], "c_custkey // 2"), pick([None, *FAMILY], "c_custkey // 6")
_G2, _F2, _B2 = pick(GIVEN, "o_custkey + o_orderkey // 5 % 2"), pick(FAMILY, "o_custkey + o_orderkey // 3 % 3"), pick([None, *FAMILY], "o_custkey // 2 + o_orderkey // 7 % 2")
_PLACE = "CASE o_orderkey % 4 WHEN 0 THEN 'Town' || o_custkey % 25 WHEN 1 THEN 'Region' || o_custkey % 5 WHEN 2 THEN 'Born' || o_custkey % 3 END"
_CEMETERY = "CASE o_orderkey % 5 WHEN 0 THEN 'Friedhof Town' || o_custkey % 25 || ' Nord' WHEN 1 THEN 'Friedhof-Region' || o_custkey % 5 WHEN 2 THEN ' ' END"


def people(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """All customers; dealt to all tasks by person where each of them costs much."""
    exprs = [e for e in Q.PAIR if e.rsplit(" AS ")[-1] in ("clo", "chi", "cp", "cs", "gender", "dead")]
    customers = table(spark, d, "customer").select("c_custkey")
    customers = Q.spread(customers, F.col("c_custkey").cast("string")) if dealt else customers
    rows = customers.selectExpr("c_custkey", *(_fix(e) for e in (*exprs, f"{_G1} AS g1", f"{_F1} AS f1", f"{_B1} AS b1", f"{_M1} AS m1")))
    none, int_ = F.array().cast("array<string>"), F.lit(None).cast("int")
    place = lambda name, region: F.struct(name.alias("name"), region.alias("region"), none.alias("aliases"))
    key = lambda p, n: F.concat(F.lit(p), (F.col("c_custkey") % n).cast("string"))
    kin = lambda i, g: F.array(F.struct(F.lit(i).alias("id"), F.struct(F.array(F.lit(g)).alias("given_names"), F.lit("Muster").alias("surname")).alias("name")))
    return rows.select(
        F.col("c_custkey").cast("string").alias("person_id"), F.struct(F.array("g1").alias("given_names"), F.col("f1").alias("surname"), F.col("b1").alias("birth_surname"), F.array_compact(F.array("m1")).alias("married_surnames")).alias("name"), "gender",
        D.date_range(F.col("clo"), F.col("chi"), F.col("cp"), F.col("cs")).alias("birth"), place(key("Born", 3), F.lit(None).cast("string")).alias("birth_place"), F.array(place(F.concat(key("Town", 25), F.lit(", Land")), key("Region", 5))).alias("places"),
        F.when(F.col("dead"), D.date_range(F.lit(1950_01_01), F.lit(1999_12_31), "interval", "known")).otherwise(D.date_range(int_, int_, "open", "unknown")).alias("tree_death"), kin("S", "Karl").alias("spouses"), kin("C", "Eva").alias("children"),
    )


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Those held: customers without a remainder of 8 are not."""
    return people(spark, d).where("CAST(person_id AS INT) % 8 > 0")


def _notices(spark: SparkSession, d: str) -> DataFrame:
    exprs = [e.replace("c_custkey", "o_custkey") for e in Q.PAIR if e.rsplit(" AS ")[-1] in ("nlo", "nhi", "np", "ns", "dy", "age")]
    rows = Q.spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey").cast("string")).selectExpr("o_orderkey", "o_custkey", *(_fix(e) for e in (*exprs, f"{_G2} AS g2", f"{_F2} AS f2", f"{_B2} AS b2", f"{_PLACE} AS place", f"{_CEMETERY} AS cemetery")))
    one = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit("x").alias("relation_guess"), F.lit(c).alias("confidence"))
    some = F.when(F.col("o_orderkey") % 3 == 1, F.array(one("Karl Muster", 0.5))).when(F.col("o_orderkey") % 3 == 2, F.array(one("Karl Muster", 1.0), one("Eva Muster", 0.9))).otherwise(F.array().cast("array<struct<name:string,relation_guess:string,confidence:double>>"))
    url, none = F.concat(F.lit("https://a.de/"), (F.col("o_orderkey") % 3).cast("string")), F.lit(None).cast("int")
    return rows.select(
        F.lit("j").alias("job_id"), F.col("o_custkey").cast("string").alias("person_id"), F.col("o_orderkey").alias("seq"), F.lit("obituary").alias("notice_type"), F.lit("n").alias("name"),
        F.struct(F.array("g2").alias("given_names"), F.col("f2").alias("surname"), F.col("b2").alias("birth_surname")).alias("parsed_name"), D.date_range(F.col("nlo"), F.col("nhi"), F.col("np"), F.col("ns")).alias("birth"),
        D.date_range(F.col("dy") * 10000 + 601, F.col("dy") * 10000 + 601, "exact", "known").alias("death"), D.date_range(none, none, "open", "unknown").alias("funeral_date"), "place", "cemetery", "age", some.alias("relatives"),
        url.alias("url"), U.row_key(url).alias("row_key"), F.lit("").alias("source"), F.when(F.col("o_orderkey") % 6 == 0, "cremation").otherwise("burial").alias("disposition"),
    )


_norm, _map = Q._sql_norm, Q._sql_map
_HELD_SQL = "c_custkey % 8 > 0"
_SCORED_SQL = f"""p AS (SELECT {", ".join(Q.PAIR)}, {_G1} AS g1, {_F1} AS f1, {_B1} AS b1, {_M1} AS m1, {_G2} AS g2, {_F2} AS f2, {_B2} AS b2, {_CEMETERY} AS cemetery FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_HELD_SQL}),
 k AS (SELECT * REPLACE ({", ".join(f"{_norm(x)} AS {x}" for x in ("g1", "g2", "f1", "f2", "b1", "b2", "m1"))}) FROM p),
 n AS (SELECT *, CASE WHEN b1 <> '' THEN b1 ELSE f1 END AS own FROM k),
 c AS (SELECT *, g1 = g2 AS exact, coalesce({_map("g1", Q._CLUSTER)} = {_map("g2", Q._CLUSTER)}, false) AS variant, b2 <> '' AND b2 = own AS born, m1 <> '' AND f2 = m1 AS married,
  NOT (b2 <> '' AND b2 = own) AND f2 = own AS same, {_map("f2", Q._CODE)} = {_map("own", Q._CODE)} AS sound FROM n),
 x AS (SELECT *, sound AND NOT born AND NOT married AND NOT same AS bysound, born OR married OR same AS role, CASE WHEN exact THEN 10 WHEN variant THEN 8 ELSE 0 END AS given FROM c),
 y AS (SELECT *, role AND exact AND f1 = f2 AND (b1 = '' OR b2 = '' OR b1 = b2) AS whole, CASE WHEN born THEN 20 ELSE 0 END + CASE WHEN married THEN 15 WHEN same THEN 10 WHEN bysound THEN 8 ELSE 0 END AS family FROM x),
 s AS (SELECT *, greatest(given + family, CASE WHEN whole THEN 40 ELSE 0 END) AS by_name, {Q._BIRTH} AS by_birth, {Q._AGE} AS by_age, {Q._PLAUSIBLE} AS by_plausible, {Q._PENALTY} AS penalty, {Q._APART} OR {Q._DEAD_APART} OR {Q._YOUNG} OR {Q._OLD} AS hard,
  CASE o_orderkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 8 WHEN 2 THEN 5 ELSE 0 END AS by_place, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 13 ELSE 35 END AS by_kin, CASE o_orderkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 0 END AS by_grave FROM y),
 t AS (SELECT *, CAST(greatest(0, least(100, least(45, by_name) + least(30, by_birth) + by_place + by_plausible - penalty)) AS INT) AS base,
  CAST(greatest(0, least(100, least(35, by_name) + least(25, by_birth) + least(10, by_place) + by_plausible + by_kin + by_age + by_grave - penalty)) AS INT) AS total FROM s)"""
_BAND_SQL = "CASE WHEN total >= 70 AND hard THEN 'possible' WHEN total >= 85 THEN 'strong' WHEN total >= 70 THEN 'probable' WHEN total >= 55 THEN 'possible' WHEN total >= 40 THEN 'weak' ELSE 'none' END"


def scr_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every notice against its person by both configurations: the signals of the full one, and both totals."""
    notices, held = ingest.notice_keys(_notices(spark, d)), ingest.candidate_keys(people(spark, d, dealt=True))
    full = ingest.score(notices, held, scoring.ScoreConfig.enriched())
    cfg, c = scoring.ScoreConfig(), F.col
    base = {"name": scoring.name_score(cfg), "birth": scoring.birth_score(cfg, c("birth"), c("n_birth")), "place": scoring.place_points(cfg, c("c_homes"), c("c_regions"), c("c_born_at"), c("n_needle")), "plausibility": c("s_plausibility")}
    return full.select("seq", *(c(f"s_{k}.score").alias(f"s_{k}") for k in ingest.SIGNALS), scoring.total(list(base.values()), c("conflicts")).alias("base"), "total", "band")


SCR_PAIRS_SQL = f"""WITH {_SCORED_SQL.replace(_HELD_SQL, "true")} SELECT o_orderkey AS seq, CAST(least(35, by_name) AS INT) AS s_name, CAST(least(25, by_birth) AS INT) AS s_birth, CAST(least(10, by_place) AS INT) AS s_place, CAST(by_plausible AS INT) AS s_plausibility,
 CAST(by_kin AS INT) AS s_relatives, CAST(by_age AS INT) AS s_age, CAST(by_grave AS INT) AS s_cemetery, base, total, {_BAND_SQL} AS band FROM t"""


def win_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rank, band, ambiguity and the reasons for them of each person's notices by the full score."""
    full = ingest.score(ingest.notice_keys(_notices(spark, d)), ingest.candidate_keys(people(spark, d, dealt=True)), scoring.ScoreConfig.enriched())
    rows = ranking.classify(full.select("person_id", "seq", "total", F.col("conflicts.hard").alias("hard")), "person_id", "total", "hard", "seq")
    return rows.select("person_id", "seq", "total", "rank", "second", "band", "ambiguous", F.array_join("reasons", "; ").alias("reasons"))


WIN_PAIRS_SQL = f"""WITH {_SCORED_SQL.replace(_HELD_SQL, "true")},
 wr AS (SELECT c_custkey, o_orderkey, total, hard, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY total DESC, o_orderkey) AS INT) AS rank FROM t),
 wb AS (SELECT c_custkey AS k, total AS best, hard AS best_hard FROM wr WHERE rank = 1),
 wx AS (SELECT k, best, max(total) FILTER (rank > 1 AND (best_hard OR NOT hard)) AS second FROM wb JOIN wr ON k = c_custkey GROUP BY ALL),
 wy AS (SELECT *, rank = 1 AND coalesce(best >= 55 AND best - second < 10, false) AS ambiguous FROM wr JOIN wx ON k = c_custkey)
 SELECT CAST(c_custkey AS VARCHAR) AS person_id, o_orderkey AS seq, total, rank, second, {_BAND_SQL} AS band, ambiguous,
 'score ' || total || CASE WHEN hard AND total >= 70 THEN '; capped to possible by a hard conflict' ELSE '' END || CASE WHEN ambiguous THEN '; runner-up within 10 points' ELSE '' END AS reasons FROM wy"""


def scr_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The conflicts of every pair, one row each, as they are shown."""
    c = F.col
    rows = Q.pairs(spark, d).select("o_orderkey", F.posexplode(scoring.conflicts(Q.CFG, c("birth"), c("tree_death"), c("n_birth"), c("n_death"))["reasons"]).alias("pos", "r"))
    return rows.select("o_orderkey", "pos", "r.field", "r.tree", "r.notice", "r.severity")


_SHOWN = lambda lo, hi, kind, status: f"CASE WHEN {status} = 'invalid' THEN '(uninterpretable)' WHEN {status} = 'unknown' THEN '' WHEN {kind} = 'exact' THEN ({lo} // 10000) || '-' || lpad(CAST({lo} // 100 % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST({lo} % 100 AS VARCHAR), 2, '0') ELSE CAST({lo} // 10000 AS VARCHAR) END"
SCR_CONFLICTS_SQL = f"""WITH {Q._PAIR_SQL}, l AS (SELECT o_orderkey, unnest(list_filter([
  CASE WHEN {Q._APART} THEN {{'field': 'birth date', 'tree': {_SHOWN("clo", "chi", "cp", "cs")}, 'notice': {_SHOWN("nlo", "nhi", "np", "ns")}, 'severity': 'hard'}} END,
  CASE WHEN {Q._DEAD_APART} THEN {{'field': 'death date', 'tree': '1950-1999', 'notice': dy || '-06-01', 'severity': 'hard'}} END,
  CASE WHEN {Q._YOUNG} THEN {{'field': 'age', 'tree': CAST(chi // 10000 AS VARCHAR), 'notice': CAST(dy AS VARCHAR), 'severity': 'hard'}} END,
  CASE WHEN {Q._OLD} THEN {{'field': 'age', 'tree': CAST(clo // 10000 AS VARCHAR), 'notice': CAST(dy AS VARCHAR), 'severity': 'hard'}} END,
  CASE WHEN cs = 'invalid' THEN {{'field': 'birth date', 'tree': '(uninterpretable)', 'notice': {_SHOWN("nlo", "nhi", "np", "ns")}, 'severity': 'soft'}} END], lambda r: r IS NOT NULL)) AS r FROM p),
 m AS (SELECT o_orderkey, r, row_number() OVER (PARTITION BY o_orderkey ORDER BY r.severity, CASE r.field WHEN 'birth date' THEN 1 WHEN 'death date' THEN 2 ELSE 3 END, r.tree DESC) - 1 AS pos FROM l)
 SELECT o_orderkey, CAST(pos AS INT) AS pos, r.field AS field, r.tree AS tree, r.notice AS notice, r.severity AS severity FROM m"""


# ---- ingest ----
def _stored(spark: SparkSession, d: str) -> DataFrame:
    """A match of each customer's first URL, in every status."""
    none, key = F.lit(None).cast("string"), F.col("c_custkey") % 4
    status = F.when(key == 0, "confirmed").when(key == 1, "rejected").when(key == 2, "uncertain").otherwise("pending")
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), U.row_key(F.lit("https://a.de/0")).alias("row_key"), F.lit("https://a.de/0").alias("url"), status.alias("status"), F.lit("why").alias("reason"), F.lit('{"score":7}').alias("match"), none.alias("write_back"), F.lit("f1").alias("origin"))


def _portals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("person_id"), F.col("event_type").alias("portal"), F.when(F.col("value") < 30, "failed").otherwise("ok").alias("status"))


def _ingested(spark: SparkSession, d: str) -> ingest.Ingested:
    return ingest.ingest(_notices(spark, d), _portals(spark, d), _people(spark, d), _stored(spark, d), origin=F.lit("f2"))


def ing_matches(spark: SparkSession, d: str) -> DataFrame:
    """The stored matches after an ingest, with what their accounts say."""
    said = F.from_json("match", "score int, classification string, hardConflict string, signals struct<conflicts:struct<score:int>>, extractedFacts string")
    m = _ingested(spark, d).matches.withColumn("m", said)
    return m.select("person_id", "url", "status", "reason", "origin", "m.score", F.col("m.classification").alias("band"), F.col("m.hardConflict").alias("hard"), F.col("m.signals.conflicts.score").alias("conflict_score"), F.col("m.extractedFacts").alias("facts"))


ING_MATCHES_SQL = f"""WITH {_SCORED_SQL},
 w AS (SELECT CAST(c_custkey AS VARCHAR) AS person_id, o_orderkey % 3 AS u, arg_max(struct_pack(total := total, band := {_BAND_SQL}, hard := hard, penalty := penalty, facts := '{{"deathDate":"' || dy || '-06-01"' || CASE WHEN trim(cemetery) <> '' THEN ',"cemetery":"' || cemetery || '"' ELSE '' END
   || CASE WHEN o_orderkey % 6 = 0 THEN ',"disposition":"cremation"' ELSE '' END || '}}'), o_orderkey) AS v FROM t GROUP BY ALL),
 o AS (SELECT CAST(c_custkey AS VARCHAR) AS person_id, 0 AS u, c_custkey % 4 AS k FROM customer)
 SELECT coalesce(o.person_id, w.person_id) AS person_id, 'https://a.de/' || coalesce(o.u, w.u) AS url, CASE WHEN k = 0 THEN 'confirmed' WHEN k = 1 THEN 'rejected' WHEN v IS NULL AND k = 2 THEN 'uncertain' ELSE 'pending' END AS status,
 CASE WHEN k <= 1 OR v IS NULL THEN 'why' END AS reason, CASE WHEN k <= 1 OR v IS NULL THEN 'f1' ELSE 'f2' END AS origin, CASE WHEN k <= 1 OR v IS NULL THEN 7 ELSE v.total END AS score,
 CASE WHEN k <= 1 OR v IS NULL THEN NULL ELSE v.band END AS band, CASE WHEN k <= 1 OR v IS NULL THEN NULL ELSE CAST(v.hard AS VARCHAR) END AS hard, CASE WHEN k <= 1 OR v IS NULL THEN NULL ELSE CAST(-v.penalty AS INT) END AS conflict_score,
 CASE WHEN k <= 1 OR v IS NULL THEN NULL ELSE v.facts END AS facts FROM o FULL JOIN w ON o.person_id = w.person_id AND o.u = w.u"""


def ing_counters(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).counters


_WARN_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS person_id, 'no_candidate' AS kind, NULL AS portal, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 8 > 0) GROUP BY o_custkey
 UNION ALL SELECT CAST(user_id AS VARCHAR), 'portal_failed', event_type, 1 FROM events WHERE value < 30 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 8 > 0)"""
ING_COUNTERS_SQL = f"""SELECT (SELECT count(*) FROM orders) AS notices_read, (SELECT count(*) FROM customer WHERE c_custkey % 8 > 0) AS candidates_found,
 (SELECT count(*) FROM (SELECT DISTINCT c_custkey, o_orderkey % 3 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 8 > 0 AND NOT (o_orderkey % 3 = 0 AND c_custkey % 4 <= 1))) AS matches_stored, (SELECT count(*) FROM ({_WARN_SQL})) AS warnings"""


def ing_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).warnings.groupBy("person_id", "kind", "portal").agg(F.sum("n").alias("n"))


ING_WARNINGS_SQL = f"SELECT person_id, kind, portal, CAST(sum(n) AS BIGINT) AS n FROM ({_WARN_SQL}) GROUP BY ALL"


def win_runner_up(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each notice with its runner-up."""
    rows = Q.win_classify(spark, d)
    best = ranking.runner_up(rows, "c_custkey", F.struct("o_orderkey", "total"))
    return best.select("c_custkey", "total", "band", "ambiguous", F.col("runner_up.o_orderkey").alias("second_key"), F.col("runner_up.total").alias("second_total"))


WIN_RUNNER_UP_SQL = f"""WITH a AS ({Q.WIN_CLASSIFY_SQL}) SELECT x.c_custkey, x.total, x.band, x.ambiguous, y.o_orderkey AS second_key, y.total AS second_total FROM a x LEFT JOIN a y ON y.c_custkey = x.c_custkey AND y.rank = 2 WHERE x.rank = 1"""


# ---- decisions ----
_EVENTS = [
    "CAST(user_id AS STRING) AS person_id",
    "CAST(event_id % 5 AS STRING) AS row_key",
    "event_id",
    "CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'view' THEN 'uncertain' WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'reject' ELSE 'revert' END AS event",
    "CASE WHEN event_id % 3 > 0 THEN 'r' || event_id % 2 END AS reason",
    "'w' || event_id AS write_back",
]


def snk_decide(spark: SparkSession, d: str) -> DataFrame:
    """Matches after a series of decisions, and how many of these were refused, and how many changed nothing."""
    events = table(spark, d, "events").selectExpr(*_EVENTS)
    none = F.lit(None).cast("string")
    stored = events.select("person_id", "row_key").distinct().where("row_key in ('0', '1')").select("person_id", "row_key", F.lit("pending").alias("status"), none.alias("reason"), none.alias("write_back"))
    rows = stores.decide(stored, events, ["person_id", "row_key"], ["event_id"])
    return rows.select("person_id", "row_key", "status", "reason", "write_back", F.array_join("outcomes", ",").alias("outcomes"))


_FOLD = """CASE event WHEN 'upsert' THEN CASE WHEN status IN ('confirmed', 'rejected') THEN 'kept' ELSE 'stored' END
  WHEN 'reject' THEN CASE WHEN status = 'confirmed' THEN 'refused' WHEN status = 'rejected' AND why IS NOT DISTINCT FROM reason THEN 'unchanged' ELSE 'rejected' END
  WHEN 'uncertain' THEN CASE WHEN status IS NULL THEN 'missing' WHEN status IN ('confirmed', 'rejected') THEN 'refused' WHEN status = 'uncertain' AND why IS NOT DISTINCT FROM reason THEN 'unchanged' ELSE 'uncertain' END
  WHEN 'confirm' THEN CASE WHEN status IS NULL THEN 'missing' WHEN status = 'confirmed' THEN 'unchanged' WHEN status = 'rejected' THEN 'refused' ELSE 'confirmed' END
  ELSE CASE WHEN status = 'confirmed' THEN 'reverted' ELSE 'refused' END END"""
SNK_DECIDE_SQL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY person_id, row_key ORDER BY event_id) AS i FROM (SELECT {", ".join(_EVENTS).replace("STRING", "VARCHAR").replace("AS reason", "AS why").replace("AS write_back", "AS wb")} FROM events)),
 r AS (SELECT DISTINCT person_id, row_key, 0 AS i, CASE WHEN row_key IN ('0', '1') THEN 'pending' END AS status, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS write_back, '' AS outcomes FROM e
  UNION ALL SELECT person_id, row_key, i, CASE WHEN o IN ('stored', 'reverted') THEN 'pending' WHEN o IN ('rejected', 'uncertain', 'confirmed') THEN o ELSE status END, CASE WHEN o IN ('stored', 'reverted') THEN NULL WHEN o IN ('rejected', 'uncertain') THEN why ELSE reason END,
   CASE WHEN o IN ('stored', 'reverted') THEN NULL WHEN o = 'confirmed' THEN wb ELSE write_back END, outcomes || CASE WHEN outcomes = '' THEN '' ELSE ',' END || o
   FROM (SELECT r.person_id, r.row_key, e.i, status, reason, write_back, outcomes, why, wb, {_FOLD} AS o FROM r JOIN e ON e.person_id = r.person_id AND e.row_key = r.row_key AND e.i = r.i + 1)),
 n AS (SELECT person_id, row_key, max(i) AS i FROM r GROUP BY ALL)
 SELECT person_id, row_key, status, reason, write_back, outcomes FROM r JOIN n USING (person_id, row_key, i)"""
SNK_REPLAY_SQL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY event_id) AS i, count(*) OVER (PARTITION BY row_key) AS n FROM (SELECT CAST(user_id * 1000 + dayofyear(ts) AS BIGINT) AS row_key, event_id, event_type AS t FROM events)),
 r AS (SELECT DISTINCT row_key, 0 AS i, n, CAST(NULL AS VARCHAR) AS status FROM e UNION ALL SELECT r.row_key, e.i, r.n,
  CASE WHEN t = 'signup' AND (status IS NULL OR status IN ('pending', 'uncertain')) THEN 'pending' WHEN t = 'error' AND (status IS NULL OR status IN ('pending', 'uncertain')) THEN 'rejected'
  WHEN t = 'view' AND status IN ('pending', 'uncertain') THEN 'uncertain' WHEN t = 'click' AND status IN ('pending', 'uncertain') THEN 'confirmed' WHEN t = 'purchase' AND status = 'confirmed' THEN 'pending' ELSE status END
  FROM r JOIN e ON e.row_key = r.row_key AND e.i = r.i + 1)
 SELECT row_key, status, CAST(n AS INT) AS n_events FROM r WHERE i = n"""


# ---- enqueue ----
_NOW, _TTL, _LIMIT = 1_000_000, 500_000, 100
_BLANK = "c_custkey % 13 = 0"
_NAMELESS = "c_custkey % 26 = 0"  # the other blank ones have an alias


def _asked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").selectExpr("c_custkey", *(_fix(e) for e in (f"{_G1} AS g1", f"{_F1} AS f1", f"{_M1} AS m1")))
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    name = F.struct(F.array("g1").alias("given_names"), F.col("f1").alias("surname"), null.alias("birth_surname"), F.array_compact(F.array("m1")).alias("married_surnames"), none.alias("aliases"))
    alias = F.when(F.expr(_NAMELESS), none).otherwise(F.array(F.lit(" "), F.lit("Lisl")))
    blank = F.struct(F.array(F.lit(" ")).alias("given_names"), F.lit("").alias("surname"), null.alias("birth_surname"), none.alias("married_surnames"), alias.alias("aliases"))
    hints = F.array(F.struct(F.concat(F.lit(" q"), F.col("c_custkey").cast("string")).alias("query"), F.lit(0).alias("priority"), F.lit("k").alias("key")), F.struct(F.lit(" ").alias("query"), F.lit(2).alias("priority"), F.lit("k").alias("key")))
    return rows.select(F.col("c_custkey").cast("string").alias("person_id"), F.when(F.expr(_BLANK), blank).otherwise(name).alias("name"), F.concat(F.lit("s"), (F.col("c_custkey") % 3).cast("string")).alias("signature"), hints.alias("hints"))


def _memory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("CAST(user_id AS STRING) AS person_id", "event_type AS finder_id", "'s' || event_id % 3 AS signature", "event_id * 100 AS recorded_at")


def _selected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    jobs = table(spark, d, "customer").selectExpr("c_custkey % 2 AS tree_id", "array(CAST(c_custkey AS STRING), CAST(c_custkey + 7 AS STRING)) AS requested_person_ids").where("element_at(requested_person_ids, 1) % 14 = 1")
    return enqueue.select_eligible(_asked(spark, d), enqueue.in_flight(jobs, 1), _memory(spark, d), "click", _LIMIT, _NOW, _TTL)


def enq_requests(spark: SparkSession, d: str) -> DataFrame:
    """The first people who may be searched for, and what is asked about them."""
    matches = table(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS person_id", f"{Q._STATUS_SQL} AS status", "'https://www.h' || o_orderkey % 4 || '.de/x' AS url")
    return enqueue.requests(_selected(spark, d)[0], matches).select("person_id", "request", F.col("n_hosts").cast("int").alias("n_hosts"))


def enq_counts(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d)[1]


_STATE_SQL = f"""j AS (SELECT DISTINCT unnest([c_custkey, c_custkey + 7]) AS k FROM customer WHERE c_custkey % 14 = 1),
 m AS (SELECT user_id, arg_max(event_id % 3, event_id) AS s, max(event_id) * 100 AS seen_at FROM events WHERE event_type = 'click' GROUP BY user_id),
 a AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS person_id, CASE WHEN c_custkey IN (SELECT k FROM j) THEN 'skipped' WHEN {_NAMELESS} THEN 'nameless' WHEN coalesce(s = c_custkey % 3 AND {_NOW} - seen_at < {_TTL}, false) THEN 'suppressed' ELSE 'eligible' END AS state,
  {_G1} AS g1, {_F1} AS f1, {_M1} AS m1 FROM customer LEFT JOIN m ON user_id = c_custkey),
 f AS (SELECT * FROM a WHERE state = 'eligible' ORDER BY person_id LIMIT {_LIMIT})"""
ENQ_COUNTS_SQL = f"WITH {_STATE_SQL}, z AS (SELECT CASE WHEN count(*) = {_LIMIT} THEN max(person_id) END AS last FROM f) SELECT count(*) FILTER (state = 'eligible') AS eligible, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'suppressed') AS suppressed FROM a, z WHERE last IS NULL OR person_id <= last"
ENQ_REQUESTS_SQL = f"""WITH {_STATE_SQL}, h AS (SELECT o_custkey, list_sort(list(DISTINCT 'h' || o_orderkey % 4 || '.de')) AS hosts FROM orders WHERE {Q._STATUS_SQL.replace("STRING", "VARCHAR")} IN ('pending', 'uncertain') GROUP BY o_custkey)
 SELECT person_id, '{{"personId":"' || person_id || '","names":[' || CASE WHEN {_BLANK} THEN '{{"kind":"alias","full":"Lisl"}}' ELSE '{{"kind":"primary","given":"' || g1 || '","surname":"' || f1 || '"}}' || CASE WHEN m1 IS NULL THEN '' ELSE ',{{"kind":"married","surname":"' || m1 || '"}}' END END || '],"queryHints":[{{"query":"q' || person_id || '","dedupKey":"k","priority":1}}]'
 || CASE WHEN hosts IS NULL THEN '' ELSE ',"excludedHosts":["' || array_to_string(hosts, '","') || '"]' END || '}}' AS request, CAST(coalesce(len(hosts), 0) AS INT) AS n_hosts FROM f LEFT JOIN h ON o_custkey = c_custkey"""


def mem_after(spark: SparkSession, d: str) -> DataFrame:
    """What is remembered of searches in vain once the finds of all finders are known: by person and finder the last."""
    outcomes = stores.search_outcome(Q._coverage(spark, d), ["user_id"]).selectExpr("CAST(user_id AS STRING) AS person_id", "outcome")
    left = enqueue.forget_found(_memory(spark, d), outcomes)
    return stores.last_wins(left, ["person_id", "finder_id"], "recorded_at")


MEM_AFTER_SQL = f"""WITH c AS (SELECT {", ".join(Q._COVERAGE)} FROM events), o AS (SELECT user_id FROM c GROUP BY user_id HAVING coalesce(sum(notice_count) FILTER (status = 'ok'), 0) > 0)
 SELECT CAST(user_id AS VARCHAR) AS person_id, event_type AS finder_id, arg_max('s' || event_id % 3, event_id) AS signature, max(event_id) * 100 AS recorded_at FROM events WHERE user_id NOT IN (SELECT user_id FROM o) GROUP BY ALL"""


# ---- worklist ----
_KIND = "CASE o_orderkey % 7 WHEN 0 THEN '\"9\"' WHEN 1 THEN 'null' ELSE CAST(CAST(floor(o_totalprice / 5000) AS INT) AS STRING) END"
_ACCOUNT = f"""CASE WHEN o_orderkey % 11 = 0 THEN '[1' ELSE '{{"score":' || {_KIND} || ',"classification":"' || CASE o_orderkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'odd' ELSE 'weak' END || '","hardConflict":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '1' END
 || ',"extractedFacts":{{"deathDate":' || CASE WHEN o_orderkey % 5 = 0 THEN '7' ELSE '"' || (1990 + o_orderkey % 30) || '-03-0' || (1 + o_orderkey % 9) || '"' END || '}}}}' END"""


def wrk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Undecided rows with a conflict, as the worklist shows them, and their place in the order by death."""
    rows = table(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS person_id", "CAST(o_orderkey AS STRING) AS row_key", f"{Q._STATUS_SQL} AS status", "'https://www.a.de/' || o_orderkey AS url", f"{_ACCOUNT} AS match")
    rows = worklist.filtered(worklist.project(rows), "open", "nonsense", "conflict")
    return rows.select("person_id", "row_key", "score", "band", "death_date", "source_host", "token", "confirmed_url").orderBy(*worklist.order("score"))


_DEATH = "CASE WHEN o_orderkey % 5 > 0 THEN '0' || (1 + o_orderkey % 9) || '.03.' || (1990 + o_orderkey % 30) END"
WRK_ROWS_SQL = f"""SELECT CAST(o_custkey AS VARCHAR) AS person_id, CAST(o_orderkey AS VARCHAR) AS row_key, CAST(CASE WHEN o_orderkey % 7 <= 1 THEN 0 ELSE floor(o_totalprice / 5000) END AS INT) AS score, CASE o_orderkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'none' ELSE 'weak' END AS band,
 {_DEATH} AS death_date, 'a.de' AS source_host, o_custkey || ':' || o_orderkey AS token, CAST(NULL AS VARCHAR) AS confirmed_url FROM orders WHERE {Q._STATUS_SQL} = 'pending' AND o_orderkey % 2 = 0 AND o_orderkey % 11 > 0"""


def wrk_tabs(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS person_id")
    matches = table(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS person_id", f"{Q._STATUS_SQL} AS status")
    outcomes = Q.agg_outcome(spark, d).selectExpr("CAST(user_id AS STRING) AS person_id", "outcome")
    return worklist.tabs(people, matches, outcomes)


WRK_TABS_SQL = f"""WITH o AS ({Q.AGG_OUTCOME_SQL}), n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE {Q._STATUS_SQL} IN ('pending', 'uncertain') GROUP BY o_custkey)
 SELECT CAST(c_custkey AS VARCHAR) AS person_id, coalesce(n, 0) AS n_suggestions, coalesce(outcome, 'skipped') AS outcome, coalesce(n, 0) > 0 OR coalesce(outcome, '') = 'portal_failed' AS shown FROM customer LEFT JOIN o ON user_id = c_custkey LEFT JOIN n ON o_custkey = c_custkey"""


def str_family(spark: SparkSession, d: str) -> DataFrame:
    """Whether the names of two parts name one person, by two shared words or both one equal word."""
    name = lambda a, b, n: F.concat_ws(" ", F.when(F.col("p_partkey") % n > 0, F.col(a)), F.col(b))
    rows = Q._people(spark, d).select("p_partkey", name("g1", "f1", 3).alias("x"), name("g2", "f2", 4).alias("y"))
    return rows.select("p_partkey", worklist.in_tree(F.array("x"), F.array("y", F.lit("Unbekannt")))[0].alias("same"), F.size(T.segments(F.concat_ws(",", "x", F.lit(" "), "y"))).alias("n"))


_FOLDS = lambda c: f"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(replace(replace(replace({c}, 'ä', 'a'), 'ü', 'u'), 'ß', 'ss')), '^dr\\. ', ''), '([aou])e', '\\1', 'g'), ' '), lambda w: w <> ''))"
STR_FAMILY_SQL = f"""WITH p AS (SELECT {", ".join(Q._PEOPLE)} FROM part), n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN g1 || ' ' ELSE '' END || f1 AS x, CASE WHEN p_partkey % 4 > 0 THEN g2 || ' ' ELSE '' END || f2 AS y FROM p),
 t AS (SELECT p_partkey, {_FOLDS("x")} AS a, {_FOLDS("y")} AS b FROM n)
 SELECT p_partkey, len(list_intersect(a, b)) >= 2 OR (len(a) = 1 AND len(b) = 1 AND a = b) AS same, 2 AS n FROM t"""

_STRIP1 = lambda c: f"regexp_replace(regexp_replace(lower(replace(replace(replace(coalesce({c}, ''), 'ä', 'a'), 'ü', 'u'), 'ß', 'ss')), '\\bdr\\. ', ''), '([aou])e', '\\1', 'g')"
STR_HINTS_SQL = f"""WITH p AS (SELECT {", ".join(Q._PEOPLE)} FROM part), y AS (SELECT *, CAST(1900 + p_size AS VARCHAR) AS y, coalesce(b1, '') AS b FROM p),
 l AS (SELECT p_partkey, unnest(list_concat(CASE WHEN m1 IS NULL THEN [] ELSE [{{'k': 1, 's': 1, 'q': g1 || ' ' || m1 || ' ' || y}}, {{'k': 3, 's': 2, 'q': g1 || ' ' || m1 || ' Bonn'}}] END,
  [{{'k': 2, 's': 3, 'q': trim(g1 || ' ' || b) || ' ' || y}}, {{'k': 4, 's': 4, 'q': g2 || ' ' || f1}}, {{'k': 5, 's': 5, 'q': trim(g1 || ' ' || b)}}, {{'k': 6, 's': 6, 'q': g2 || ' ' || f1 || ' ' || y}}, {{'k': 7, 's': 7, 'q': g2 || ' ' || f1 || ' Bonn'}}])) AS h FROM y),
 d AS (SELECT p_partkey, h, row_number() OVER (PARTITION BY p_partkey, {_STRIP1("h.q")} ORDER BY h.s) AS n FROM l)
 SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY h.k, h.s) - 1 AS INT) AS pos, h.q AS query, h.k AS priority FROM d WHERE n = 1"""

QUERIES = {
    "scr_pairs": scr_pairs, "win_pairs": win_pairs, "scr_conflicts": scr_conflicts, "ing_matches": ing_matches, "ing_counters": ing_counters, "ing_warnings": ing_warnings, "win_runner_up": win_runner_up, "snk_decide": snk_decide,
    "enq_requests": enq_requests, "enq_counts": enq_counts, "mem_after": mem_after, "wrk_rows": wrk_rows, "wrk_tabs": wrk_tabs, "str_family": str_family,
}
ORACLE_SQL = {
    "scr_pairs": SCR_PAIRS_SQL, "win_pairs": WIN_PAIRS_SQL, "scr_conflicts": SCR_CONFLICTS_SQL, "ing_matches": ING_MATCHES_SQL, "ing_counters": ING_COUNTERS_SQL, "ing_warnings": ING_WARNINGS_SQL, "win_runner_up": WIN_RUNNER_UP_SQL, "snk_decide": SNK_DECIDE_SQL,
    "enq_requests": ENQ_REQUESTS_SQL, "enq_counts": ENQ_COUNTS_SQL, "mem_after": MEM_AFTER_SQL, "wrk_rows": WRK_ROWS_SQL, "wrk_tabs": WRK_TABS_SQL, "str_family": STR_FAMILY_SQL, "snk_replay": SNK_REPLAY_SQL, "str_query_hints": STR_HINTS_SQL,
}
