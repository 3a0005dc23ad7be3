"""Queries of a tree's tables, of sources, settings, capabilities and stored documents over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import review, worklist
from ..sources import settings, tree
from .queries import _STATUS_SQL
from .tables import spread, table

# ---- people: a customer each; a family of each, with the next one as spouse and the two after that as children ----
_LINKS = "stack(4, c_custkey, 'spouse', 0, c_custkey + 1, 'spouse', 1, c_custkey + 2, 'child', 2, c_custkey + 3, 'child', 3) AS (p, role, seq)"


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # Dealt to all tasks by what they are grouped by; a small file would be one task, which has to hold and sort all that its rows become.
    person = lambda name, key, *more: spread(table(spark, d, name).select(key, *more), F.col(key).cast("string"))
    customers, none = person("customer", "c_custkey"), F.lit(None).cast("int")
    unknown = D.date_range(none, none, "open", "unknown")
    people = customers.select(F.col("c_custkey").cast("string").alias("person_id"), F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F").otherwise("U").alias("sex"), (F.col("c_custkey") % 10 > 0).alias("visible"), unknown.alias("birth"), unknown.alias("death"))
    rows = "stack(5, 1, true, 'NAME', CASE WHEN c_custkey % 6 = 0 THEN '@P.N.' ELSE concat(' Anna  Eva', c_custkey % 4, ' ') END, CASE WHEN c_custkey % 7 = 0 THEN '@N.N.' ELSE concat('Alt', c_custkey % 9) END, 2, false, '_MARNM', 'x', 'Neu', 3, false, '_MARNM', 'y', concat('Mehr', c_custkey % 2), 0, false, 'NAME', 'Nele', 'z', 4, false, '_AKA', 'No', 'No') AS (seq, main, type, givn, surn)"
    names = customers.selectExpr("CAST(c_custkey AS STRING) AS person_id", rows)
    facts = person("orders", "o_custkey", "o_orderkey").selectExpr("CAST(o_custkey AS STRING) AS person_id", "o_orderkey AS seq", "CASE o_orderkey % 3 WHEN 0 THEN 'BIRT' WHEN 1 THEN 'RESI' ELSE 'DEAT' END AS tag", "CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE concat(' P', o_orderkey % 4, ' ') END AS place")
    links = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey AS family_id", _LINKS).selectExpr("family_id", "CAST(p AS STRING) AS person_id", "role", "seq")
    return people, names, facts, links


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The records of two customers of three: one has its call name on a second line, the other none."""
    record = "concat('0 @I', c_custkey, '@ INDI\\n1 NAME Anna /Alt/\\n', CASE WHEN c_custkey % 3 = 0 THEN concat('2 _RUFNAME  Eva', c_custkey % 4, ' \\n2 _RUFNAME No') ELSE '1 NOTE _RUFNAME no' END) AS record"
    return table(spark, d, "customer").where("c_custkey % 3 < 2").selectExpr("CAST(c_custkey AS STRING) AS person_id", record)


def tree_people(spark: SparkSession, d: str) -> DataFrame:
    """The visible people with names, places and the number of their visible spouses and children."""
    rows = tree.hydrate(*_tree(spark, d), records=_records(spark, d))
    joined = lambda c: F.array_join(c, ",")
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return rows.select(
        "person_id", "gender", joined("name.given_names").alias("given"), F.col("name.call_name").alias("called"), F.col("name.surname").alias("surname"), F.col("name.birth_surname").alias("born"), joined("name.married_surnames").alias("married"), joined("name.aliases").alias("aliases"),
        F.coalesce(joined(F.col("places.name")), F.lit("")).alias("places"), F.col("birth_place.name").alias("birth_place"), n("spouses").alias("n_spouses"), n("children").alias("n_children"),
    )


_KIN_SQL = """l AS (SELECT c_custkey AS f, unnest([c_custkey, c_custkey + 1, c_custkey + 2, c_custkey + 3]) AS p, unnest(['spouse', 'spouse', 'child', 'child']) AS r, unnest([0, 1, 2, 3]) AS s FROM customer),
 k AS (SELECT a.p AS p, b.p AS m, CASE WHEN a.r = 'child' THEN 'parent' ELSE b.r END AS r, row_number() OVER (PARTITION BY a.p, b.p ORDER BY a.r = 'child', a.f, b.r <> 'spouse', b.s) AS n, a.r = 'child' AS late, a.f AS f, b.r <> 'spouse' AS c, b.s AS s
  FROM l a JOIN l b ON a.f = b.f AND a.p <> b.p AND (a.r = 'spouse' OR b.r = 'spouse')),
 q AS (SELECT k.* FROM k JOIN customer ON m = c_custkey WHERE n = 1 AND m % 10 > 0)"""
TREE_PEOPLE_SQL = f"""WITH {_KIN_SQL}, g AS (SELECT o_custkey, list('P' || o_orderkey % 4 ORDER BY o_orderkey) AS ps FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 4 > 0 GROUP BY o_custkey),
 z AS (SELECT p, count(*) FILTER (r = 'spouse') AS sp, count(*) FILTER (r = 'child') AS ch FROM q GROUP BY p)
 SELECT CAST(c_custkey AS VARCHAR) AS person_id, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Anna,Eva' || c_custkey % 4 END AS given, CASE WHEN c_custkey % 3 = 0 THEN 'Eva' || c_custkey % 4 END AS called,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Alt' || c_custkey % 9 END AS surname, CASE WHEN c_custkey % 7 > 0 THEN 'Alt' || c_custkey % 9 END AS born, 'Neu,Mehr' || c_custkey % 2 AS married, 'Nele' AS aliases,
 coalesce(array_to_string(ps, ','), '') AS places, ps[1] AS birth_place, CAST(coalesce(sp, 0) AS INT) AS n_spouses, CAST(coalesce(ch, 0) AS INT) AS n_children FROM customer LEFT JOIN g ON o_custkey = c_custkey LEFT JOIN z ON p = c_custkey WHERE c_custkey % 10 > 0"""


def tree_family(spark: SparkSession, d: str) -> DataFrame:
    """Family members of each person as a review shows them: the first relation of each, in order."""
    people, _, _, links = _tree(spark, d)
    return tree.family_view(links, people).join(people.select("person_id").hint("merge"), "person_id", "left_semi").select("person_id", "member", "relation", "place")


TREE_FAMILY_SQL = f"""WITH {_KIN_SQL} SELECT CAST(p AS VARCHAR) AS person_id, CAST(m AS VARCHAR) AS member, r AS relation, CAST(row_number() OVER (PARTITION BY p ORDER BY late, f, c, s) AS INT) AS place FROM q WHERE p IN (SELECT c_custkey FROM customer)"""

_QUALIFIERS = ["", "ABT ", "BET ", "FROM ", "BEF ", "est ", "CAL "]


def tree_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of a tree, in all qualifiers and precisions, some of them in the wrong order, not understood, or empty."""
    word = F.element_at(F.array(*(F.lit(q) for q in _QUALIFIERS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    y, m, x = (F.expr(e).cast("int") for e in ("year(o_orderdate)", "CASE WHEN o_orderkey % 5 < 3 THEN month(o_orderdate) ELSE 0 END", "CASE WHEN o_orderkey % 5 < 2 THEN day(o_orderdate) ELSE 0 END"))
    y2 = y + F.when(F.col("o_orderkey") % 11 == 0, 1).when(F.col("o_orderkey") % 11 == 1, -1).otherwise(0)
    raw = F.when(F.col("o_orderkey") % 13 == 0, F.lit(" ")).otherwise(F.concat(word, F.lit("D "), y.cast("string")))
    rows = table(spark, d, "orders").select("o_orderkey", tree.tree_date(raw, F.col("o_orderkey") % 17 > 0, y, m, x, y2, m, x).alias("r"))
    return rows.select("o_orderkey", "r.status", "r.precision", "r.lo", "r.hi")


TREE_DATES_SQL = """WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(CASE WHEN o_orderkey % 5 < 3 THEN month(o_orderdate) ELSE 0 END AS INT) AS m, CAST(CASE WHEN o_orderkey % 5 < 2 THEN day(o_orderdate) ELSE 0 END AS INT) AS d, CASE o_orderkey % 11 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS s FROM orders),
 b AS (SELECT *, least(y, y + s) AS a, greatest(y, y + s) AS z FROM o), e AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'unknown' WHEN k % 17 = 0 THEN 'invalid' ELSE 'known' END AS status FROM b)
 SELECT k AS o_orderkey, status, CASE WHEN status <> 'known' THEN 'open' WHEN k % 7 IN (1, 5, 6) THEN 'approximate' WHEN k % 7 IN (2, 3) OR s <> 0 THEN 'interval' WHEN d > 0 THEN 'exact' WHEN m > 0 THEN 'month' ELSE 'year' END AS precision,
 CAST(CASE WHEN status = 'known' THEN a * 10000 + greatest(m, 1) * 100 + greatest(d, 1) END AS INT) AS lo,
 CAST(CASE WHEN status = 'known' THEN z * 10000 + CASE WHEN m = 0 THEN 1231 WHEN d > 0 THEN m * 100 + d ELSE m * 100 + day(last_day(make_date(z, m, 1))) END END AS INT) AS hi FROM e"""


def tree_sources(spark: SparkSession, d: str) -> DataFrame:
    """The source that each host's notices cite, or the record of the one to be made."""
    record = lambda n: F.concat(F.lit("0 @S@ SOUR\n1 REFN portal:h"), (F.col("s_suppkey") % n).cast("string"), F.lit("\n1 PUBL x"))
    base = table(spark, d, "supplier")
    accepted = base.select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("source_id"), record(7).alias("record"))
    pending = base.where("s_suppkey % 3 = 0").select(F.concat(F.lit("S"), F.lpad((F.col("s_suppkey") * F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(1000)).cast("string"), 6, "0")).alias("source_id"), F.col("s_suppkey").alias("change_id"), record(11).alias("record"))
    hosts = table(spark, d, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("host"))
    rows = tree.portal_sources(accepted, pending, hosts)
    return rows.select("host", "source", F.when(F.col("source").isNull(), tree.new_source(F.col("host"))).alias("new"))


TREE_SOURCES_SQL = r"""WITH p AS (SELECT 'S' || lpad(CAST(s_suppkey * CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 1000 END AS VARCHAR), 6, '0') AS id, arg_max('h' || s_suppkey % 11, s_suppkey) AS host FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1),
 a AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, 'h' || s_suppkey % 7 AS host FROM supplier WHERE 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') NOT IN (SELECT id FROM p)),
 x AS (SELECT host, arg_min(id, (r, id)) AS source FROM (SELECT 0 AS r, * FROM a UNION ALL SELECT 1, * FROM p) GROUP BY host)
 SELECT 'h' || n_nationkey AS host, source, CASE WHEN source IS NULL THEN '0 @@ SOUR' || chr(10) || '1 TITL Death notice: h' || n_nationkey || chr(10) || '1 PUBL h' || n_nationkey || chr(10) || '1 REFN portal:h' || n_nationkey END AS new FROM nation LEFT JOIN x ON host = 'h' || n_nationkey"""

# ---- settings and documents ----
_MORE = """CASE WHEN c_custkey % 5 = 0 THEN 'nonsense' ELSE concat('[{"active":true,"baseUrl":"https://b', c_custkey % 2, '.de/","token":"t"},{"active":"yes","baseUrl":"https://c.de"},7,{"active":true,"baseUrl":"https://a.de//","token":5},{"active":true,"baseUrl":"ftp://d.de"},{"active":true,"baseUrl":"http://u:p@e.de"},{"active":true,"baseUrl":"https://[::1]:8080/x/"},{"active":true,"baseUrl":"https://g.de:99999"},{"active":true,"baseUrl":"https://h.de:65535"}]') END"""


def cfg_finders(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey AS owner", "CASE WHEN c_custkey % 4 = 0 THEN 'https:///x' ELSE 'https://a.de' END AS base_url", "'' AS token", f"{_MORE} AS additional")
    return settings.finders(rows).select("owner", "seq", "key", "token")


CFG_FINDERS_SQL = """SELECT c_custkey AS owner, 0 AS seq, 'https://a.de' AS key, CAST(NULL AS VARCHAR) AS token FROM customer WHERE c_custkey % 4 > 0
 UNION ALL SELECT c_custkey, 1, 'https://b' || c_custkey % 2 || '.de', 't' FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 4, 'https://a.de', NULL FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 4 = 0
 UNION ALL SELECT c_custkey, 7, 'https://[::1]:8080/x', NULL FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 9, 'https://h.de:65535', NULL FROM customer WHERE c_custkey % 5 > 0"""

_DOC = """concat('{"finderId":', CASE WHEN o_orderkey % 11 = 0 THEN '""' ELSE '"f"' END, ',"retentionSeconds":', CASE WHEN o_orderkey % 13 = 0 THEN '31536001' ELSE '60' END, ',"schemaVersions":', CASE WHEN o_orderkey % 7 = 0 THEN '["1",0]' ELSE '[1,1,2,"3",1001]' END,
 ',"portals":[{"id":"', CASE WHEN o_orderkey % 5 = 0 THEN 'UP' ELSE 'p.1' END, '","country":"', CASE WHEN o_orderkey % 2 = 0 THEN 'DE' ELSE 'de' END, '","regions":["r",1]},7],"finderVersion":5,"features":{"x":true,"y":1}', CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',"noticeFields":["age","odd","birth"]' ELSE CASE WHEN o_orderkey % 17 = 0 THEN ',"noticeFields":[1]' ELSE ',"noticeFields":[]' END END, '}')"""


def cap_documents(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each capability document."""
    rows = settings.capabilities(table(spark, d, "orders").selectExpr("o_orderkey", f"{_DOC} AS raw"))
    c = "capability"
    return rows.select(
        "o_orderkey", f"{c}.finder_id", f"{c}.finder_version", f"{c}.retention_seconds", F.array_join(f"{c}.schema_versions", ",").alias("versions"), F.array_join(F.col(f"{c}.portals")["id"], ",").alias("portals"), F.get(F.col(f"{c}.portals"), F.lit(0))["country"].alias("country"),
        F.array_join(F.flatten(F.col(f"{c}.portals")["regions"]), ",").alias("regions"), F.array_join(f"{c}.notice_fields", ",").alias("fields"), F.array_join(F.map_keys(f"{c}.features"), ",").alias("flags"),
    )


CAP_DOCUMENTS_SQL = """WITH o AS (SELECT o_orderkey AS k, NOT (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR (o_orderkey % 3 = 2 AND o_orderkey % 17 = 0)) AS ok FROM orders)
 SELECT k AS o_orderkey, CASE WHEN ok THEN 'f' END AS finder_id, CAST(NULL AS VARCHAR) AS finder_version, CASE WHEN ok THEN CAST(60 AS BIGINT) END AS retention_seconds, CASE WHEN ok THEN '1,2' END AS versions, CASE WHEN ok THEN 'p.1' END AS portals,
 CASE WHEN ok AND k % 2 = 0 THEN 'DE' END AS country, CASE WHEN ok THEN 'r' END AS regions, CASE WHEN ok THEN CASE WHEN k % 3 = 1 THEN 'age,birth' ELSE '' END END AS fields, CASE WHEN ok THEN 'x' END AS flags FROM o"""


def src_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents: which are corrupt, misfiled, or of use, with their fields."""
    raw = f"""CASE o_orderkey % 9 WHEN 0 THEN '{{"personId"' WHEN 1 THEN '[]' ELSE concat('{{"personId":', CASE WHEN o_orderkey % 9 = 2 THEN '7' ELSE concat('"', o_custkey, '"') END, ',"obituaryUrl":"u","status":"', CASE WHEN o_orderkey % 9 = 3 THEN 'open' ELSE {_STATUS_SQL} END, '","match":{{"score":1}},"reason":', CASE o_orderkey % 9 WHEN 4 THEN '5' WHEN 5 THEN '"r"' ELSE 'null' END, '}}') END"""
    rows = worklist.decoded(table(spark, d, "orders").selectExpr("o_orderkey", "sha2(CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 7 END AS STRING), 256) AS folder", f"{raw} AS raw"))
    own = worklist.in_place(rows.where("ok")).select("o_orderkey", F.lit(True).alias("own"))
    return rows.join(own, "o_orderkey", "left").select("o_orderkey", "ok", "person_id", "status", "reason", F.coalesce("own", F.lit(False)).alias("own"))


SRC_DECODED_SQL = f"""WITH o AS (SELECT *, o_orderkey % 9 > 4 AS ok FROM orders) SELECT o_orderkey, ok, CASE WHEN ok THEN CAST(o_custkey AS VARCHAR) END AS person_id, CASE WHEN ok THEN {_STATUS_SQL} END AS status, CASE WHEN o_orderkey % 9 = 5 THEN 'r' END AS reason, ok AND (o_orderkey % 2 = 0 OR o_custkey = 7) AS own FROM o"""


# ---- write-back and its end ----
_ISO = "CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-02-30') WHEN 1 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
_GRAVE = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' Alt@Nord ' END"
_FUNERAL = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '2024-13-01' ELSE '2024-03-09' END"
_URL = "CASE WHEN o_orderkey % 13 = 0 THEN 'ftp://a.de/1' WHEN o_orderkey % 13 = 1 THEN 'https://a.de/@1' ELSE 'https://a.de/1' END"


def snk_write_back(spark: SparkSession, d: str) -> DataFrame:
    """What each confirmation writes, or why it does not."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_ISO} AS iso", f"{_GRAVE} AS grave", f"{_FUNERAL} AS funeral", f"{_URL} AS url")
    k = F.col("o_orderkey")
    w = review.write_back(F.col("iso"), F.col("grave"), F.col("funeral"), F.col("url"), k % 8 < 4, F.lit("S1"), k % 7 == 0, k % 17 == 0, F.lit("2024-05-06"))
    return rows.select("o_orderkey", w.alias("w")).select("o_orderkey", "w.*")


_CITED = "chr(10) || '2 SOUR @S1@' || chr(10) || '3 PAGE ' || replace(url, '@', '@@') || chr(10) || '3 DATA' || chr(10) || '4 DATE 6 MAY 2024'"
SNK_WRITE_BACK_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate, {_URL} AS url, o_orderkey % 8 < 4 AS burnt, o_orderkey % 4 >= 2 AS grave, o_orderkey % 5 > 0 AND (o_orderkey % 8 < 4 OR o_orderkey % 4 >= 2) AS dated FROM orders),
 r AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'url_not_clean' WHEN k % 6 <= 1 THEN 'no_exact_death_date' WHEN dated AND k % 5 = 1 THEN 'no_exact_funeral_date' WHEN k % 7 = 0 THEN 'death_date_present' END AS reason FROM o),
 w AS (SELECT *, CASE WHEN reason IS NULL THEN '1 DEAT' || chr(10) || '2 DATE ' || day(o_orderdate) || ' ' || ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'][month(o_orderdate)] || ' ' || year(o_orderdate) || {_CITED} END AS death,
  CASE WHEN reason IS NULL AND (burnt OR grave) AND k % 17 > 0 THEN CASE WHEN burnt THEN '1 CREM' ELSE '1 BURI' END || CASE WHEN dated THEN chr(10) || '2 DATE 9 MAR 2024' ELSE '' END || CASE WHEN grave THEN chr(10) || '2 PLAC Alt@@Nord' ELSE '' END || {_CITED} END AS event FROM r)
 SELECT k AS o_orderkey, reason, death, event, md5(death) AS death_id, CASE WHEN NOT burnt THEN md5(event) END AS buri_id, CASE WHEN burnt THEN md5(event) END AS crem_id FROM w"""


def snk_revert_outcome(spark: SparkSession, d: str) -> DataFrame:
    """What comes of taking back each confirmation."""
    k, ids = F.col("o_orderkey"), lambda *x: F.array(*(F.lit(i) for i in x))
    there = F.when(k % 3 == 0, ids("f2", "f1", "f9")).when(k % 3 == 1, ids("f1"))
    outcome = review.revert_outcome(F.when(k % 7 > 0, ids("f1", "f2")), there, k % 5 == 0)
    return table(spark, d, "orders").select("o_orderkey", outcome.alias("x")).select("o_orderkey", "x.*")


SNK_REVERT_OUTCOME_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS bad, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, o_orderkey % 5 = 0 AS force FROM orders)
 SELECT o_orderkey, CASE WHEN bad THEN 'invalid_write_back' WHEN n < 2 AND NOT force THEN 'refused_edited' WHEN n = 1 THEN 'partial' ELSE 'reverted' END AS outcome, CASE WHEN bad OR (n < 2 AND NOT force) THEN 0 ELSE n END AS deleted, CASE WHEN bad THEN 0 ELSE 2 END AS target FROM o"""

QUERIES = {
    "tree_people": tree_people, "tree_family": tree_family, "tree_dates": tree_dates, "tree_sources": tree_sources, "cfg_finders": cfg_finders, "cap_documents": cap_documents, "src_decoded": src_decoded,
    "snk_write_back": snk_write_back, "snk_revert_outcome": snk_revert_outcome,
}
ORACLE_SQL = {
    "tree_people": TREE_PEOPLE_SQL, "tree_family": TREE_FAMILY_SQL, "tree_dates": TREE_DATES_SQL, "tree_sources": TREE_SOURCES_SQL, "cfg_finders": CFG_FINDERS_SQL, "cap_documents": CAP_DOCUMENTS_SQL, "src_decoded": SRC_DECODED_SQL,
    "snk_write_back": SNK_WRITE_BACK_SQL, "snk_revert_outcome": SNK_REVERT_OUTCOME_SQL,
}
