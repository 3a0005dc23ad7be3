"""Record-linkage operators over the driver's tables. There is no person or notice table, so people and notices are derived from keys by arithmetic that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from ..operators import ranking, scoring, stores
from . import review as _review
from .tables import spread, table

CFG = scoring.ScoreConfig()
GIVEN = ["Elise", "Hans", "Dr. Johann", "Maria", "Käthe", "Lisa", "Wolfgang", "Marie", "Heinz", "Anna"]
FAMILY = ["Müller", "Meyer", "Maier", "Schmidt", "Schmitt", "Weiß", "Becker", "Mueller"]


def pick(values: list[str | None], index: str) -> str:
    """SQL for the index-th of values, modulo their number."""
    arms = " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values))
    return f"(CASE ({index}) % {len(values)} {arms} END)"


# A pair for each order: the customer is the person, the order the notice. Years and precisions run through all branches.
CY, NY = "(1900 + c_custkey % 60)", "(1900 + c_custkey % 60 + CASE o_orderkey % 5 WHEN 3 THEN 1 WHEN 4 THEN -40 ELSE 0 END)"
CKIND, NKIND = "(c_custkey % 5)", "(o_orderkey % 4)"  # 0 exact, 1 month, 2 year, 3 unknown, 4 invalid
CM, NM, CD, ND = "(1 + c_custkey % 12)", "(1 + (c_custkey + o_orderkey // 7 % 2) % 12)", "(1 + c_custkey % 28)", "(1 + (c_custkey + o_orderkey // 11 % 2) % 28)"
DY = "(1960 + o_orderkey % 75)"


def bounds(y: str, m: str, d: str, kind: str) -> tuple[str, str]:
    lo = f"CAST(CASE {kind} WHEN 0 THEN {y} * 10000 + {m} * 100 + {d} WHEN 1 THEN {y} * 10000 + {m} * 100 + 1 WHEN 2 THEN {y} * 10000 + 101 END AS INT)"
    last = f"CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} <> 2 THEN 31 WHEN {y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0) THEN 29 ELSE 28 END"
    hi = f"CAST(CASE {kind} WHEN 0 THEN {y} * 10000 + {m} * 100 + {d} WHEN 1 THEN {y} * 10000 + {m} * 100 + {last} WHEN 2 THEN {y} * 10000 + 1231 END AS INT)"
    return lo, hi


_PRECISION = "CASE {} WHEN 0 THEN 'exact' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'open' END"
_STATUS = "CASE {} WHEN 3 THEN 'unknown' WHEN 4 THEN 'invalid' ELSE 'known' END"
PAIR = [
    "o_orderkey", "c_custkey", *(f"{e} AS {n}" for e, n in zip((*bounds(CY, CM, CD, CKIND), *bounds(NY, NM, ND, NKIND)), ("clo", "chi", "nlo", "nhi"), strict=True)),
    f"{_PRECISION.format(CKIND)} AS cp", f"{_STATUS.format(CKIND)} AS cs", f"{_PRECISION.format(NKIND)} AS np", f"{_STATUS.format(NKIND)} AS ns",
    f"CAST({DY} AS INT) AS dy", f"CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {DY} - {CY} + o_orderkey % 8 - 3 END AS INT) AS age",
    f"{pick(['male', 'female', 'unknown'], 'c_custkey')} AS gender", "(c_custkey % 9 = 0) AS dead",
]


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with date ranges; the join is by key, sides pruned to it."""
    both = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.selectExpr(*(e.replace(" // 7", " div 7").replace(" // 11", " div 11") for e in PAIR))
    none = F.lit(None).cast("int")
    death = D.date_range(F.col("dy") * 10000 + 601, F.col("dy") * 10000 + 601, "exact", "known")
    tree = F.when(F.col("dead"), D.date_range(F.lit(1950_01_01), F.lit(1999_12_31), "interval", "known")).otherwise(D.date_range(none, none, "open", "unknown"))
    return rows.withColumns({"birth": D.date_range(F.col("clo"), F.col("chi"), F.col("cp"), F.col("cs")), "n_birth": D.date_range(F.col("nlo"), F.col("nhi"), F.col("np"), F.col("ns")), "n_death": death, "tree_death": tree})


_PAIR_SQL = f"p AS (SELECT {', '.join(PAIR)} FROM orders JOIN customer ON o_custkey = c_custkey)"
_BIRTH = """CASE WHEN cs <> 'known' OR ns <> 'known' THEN 0
 WHEN cp = 'exact' AND np = 'exact' THEN CASE WHEN clo = nlo THEN 30 ELSE 0 END
 WHEN np = 'exact' AND nlo BETWEEN clo AND chi THEN 25 WHEN cp = 'exact' AND clo BETWEEN nlo AND nhi THEN 25
 WHEN cp IN ('exact', 'month') AND np IN ('exact', 'month') AND clo // 100 = nlo // 100 THEN 22
 WHEN clo // 10000 = nlo // 10000 THEN 16 WHEN clo <= nhi AND nlo <= chi THEN 5 ELSE 0 END"""
_AGE = """CASE WHEN age IS NULL OR clo IS NULL THEN 0 WHEN greatest(clo // 10000 - (dy - age), dy - age - 1 - chi // 10000, 0) = 0 THEN 20
 WHEN greatest(clo // 10000 - (dy - age), dy - age - 1 - chi // 10000, 0) <= 2 THEN 10 ELSE 0 END"""
_PLAUSIBLE = "CASE WHEN dead THEN 0 ELSE 3 END + CASE WHEN gender <> 'unknown' THEN 2 ELSE 0 END + CASE WHEN dy - chi // 10000 >= 10 AND dy - clo // 10000 <= 120 THEN 5 ELSE 0 END"
_APART = "coalesce(NOT (clo <= nhi AND nlo <= chi), false)"
_DEAD_APART = "(dead AND NOT (dy * 10000 + 601 BETWEEN 19500101 AND 19991231))"
_YOUNG, _OLD = "coalesce(dy - chi // 10000 < 10, false)", "coalesce(dy - clo // 10000 > 120, false)"
_PENALTY = f"least(50, CASE WHEN {_APART} THEN 30 ELSE 0 END + CASE WHEN {_DEAD_APART} THEN 30 ELSE 0 END + CASE WHEN {_YOUNG} THEN 20 ELSE 0 END + CASE WHEN {_OLD} THEN 20 ELSE 0 END)"


def scr_dates(spark: SparkSession, d: str) -> DataFrame:
    """Birth, age and plausibility scores and the conflict penalty of every pair."""
    c = F.col
    wide = scoring.ScoreConfig(age=20)
    dates = c("birth"), c("tree_death"), c("n_birth"), c("n_death")
    tests = scoring.conflict_tests(wide, *dates)
    rows = pairs(spark, d).withColumns(tests).select(
        "o_orderkey", "c_custkey", scoring.birth_score(wide, c("birth"), c("n_birth"))["score"].alias("birth_score"), scoring.age_score(wide, c("birth"), c("age"), c("n_death"))["score"].alias("age_score"),
        scoring.plausibility_score(wide, c("gender"), c("birth"), c("tree_death"), c("n_death"))["score"].alias("plausibility_score"), scoring.conflicts(wide, *dates, {k: c(k) for k in tests}).alias("x"),
    )
    return rows.select("o_orderkey", "c_custkey", "birth_score", "age_score", "plausibility_score", F.col("x.penalty").alias("penalty"), F.col("x.hard").alias("hard"), F.col("x.n").alias("n_reasons"))


SCR_DATES_SQL = f"""WITH {_PAIR_SQL} SELECT o_orderkey, c_custkey, CAST({_BIRTH} AS INT) AS birth_score, CAST({_AGE} AS INT) AS age_score, CAST({_PLAUSIBLE} AS INT) AS plausibility_score,
 CAST({_PENALTY} AS INT) AS penalty, {_APART} OR {_DEAD_APART} OR {_YOUNG} OR {_OLD} AS hard,
 CAST(CAST({_APART} AS INT) + CAST({_DEAD_APART} AS INT) + CAST({_YOUNG} AS INT) + CAST({_OLD} AS INT) + CAST(cs = 'invalid' AS INT) AS INT) AS n_reasons FROM p"""


def win_classify(spark: SparkSession, d: str) -> DataFrame:
    """Rank, band and ambiguity of the candidates (orders) of each notice (customer)."""
    rows = scr_dates(spark, d).select("c_custkey", "o_orderkey", F.least(F.lit(100), F.greatest(F.lit(0), F.col("birth_score") * 2 + F.col("age_score") + F.col("plausibility_score") - F.col("penalty"))).cast("int").alias("total"), "hard")
    return ranking.classify(rows, "c_custkey", "total", "hard", "o_orderkey").select("c_custkey", "o_orderkey", "total", "hard", "rank", "second", "band", "ambiguous")


WIN_CLASSIFY_SQL = f"""WITH s AS ({SCR_DATES_SQL}), t AS (SELECT c_custkey, o_orderkey, CAST(least(100, greatest(0, birth_score * 2 + age_score + plausibility_score - penalty)) AS INT) AS total, hard FROM s),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY total DESC, o_orderkey) AS INT) AS rank FROM t),
 b AS (SELECT c_custkey AS k, total AS best, hard AS best_hard FROM r WHERE rank = 1),
 x AS (SELECT k, best, max(total) FILTER (rank > 1 AND (best_hard OR NOT hard)) AS second FROM b JOIN r ON k = c_custkey GROUP BY ALL)
 SELECT c_custkey, o_orderkey, total, hard, rank, second,
 CASE WHEN total >= 70 AND hard THEN 'possible' WHEN total >= 85 THEN 'strong' WHEN total >= 70 THEN 'probable' WHEN total >= 55 THEN 'possible' WHEN total >= 40 THEN 'weak' ELSE 'none' END AS band,
 rank = 1 AND coalesce(best >= 55 AND best - second < 10, false) AS ambiguous FROM r JOIN x ON k = c_custkey"""

# ---- names ----
_PEOPLE = [
    "p_partkey", "p_size", f"{pick(GIVEN, 'p_partkey')} AS g1", f"{pick(GIVEN, 'p_partkey // 3')} AS g2", f"{pick(FAMILY, 'p_partkey')} AS f1", f"{pick(FAMILY, 'p_partkey // 5')} AS f2",
    f"{pick([*FAMILY, None], 'p_partkey // 2')} AS b1", f"{pick([None, *FAMILY], 'p_partkey // 4')} AS b2", f"{pick([None, *FAMILY], 'p_partkey // 6')} AS m1",
]


def _people(spark: SparkSession, d: str) -> DataFrame:
    fix = lambda e: re.sub(r"// (\d+)", r"div \1", e)
    return spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr(*(fix(e) for e in _PEOPLE))


def scr_name(spark: SparkSession, d: str) -> DataFrame:
    """Name score of a person and a notice derived from each part."""
    person = F.struct(F.array("g1").alias("given_names"), F.col("f1").alias("surname"), F.col("b1").alias("birth_surname"), F.array_compact(F.array("m1")).alias("married_surnames"))
    notice = F.struct(F.array("g2").alias("given_names"), F.col("f2").alias("surname"), F.col("b2").alias("birth_surname"), F.array().cast("array<string>").alias("married_surnames"))
    rows = _people(spark, d).withColumns({"person": person, "notice": notice})
    rows = scoring.with_keys(scoring.with_keys(rows, "person", "c"), "notice", "n").withColumn("s", scoring.name_score(CFG))
    return rows.select("p_partkey", F.col("s.score").alias("name_score"), F.array_join("s.reasons", "; ").alias("reasons"))


def _sql_norm(c: str) -> str:
    return f"trim(regexp_replace(lower(replace(replace(replace(coalesce({c}, ''), 'ü', 'ue'), 'ä', 'ae'), 'ß', 'ss')), '^dr\\. ', ''))"


_CODE = {"mueller": "657", "meyer": "67", "maier": "67", "schmidt": "862", "schmitt": "862", "weiss": "38", "becker": "147", "": ""}
_CLUSTER = {"elise": 0, "lisa": 0, "hans": 1, "johann": 1, "kaethe": 3, "heinz": 4, "wolfgang": 7, "maria": 9, "marie": 9}
_sql_map = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in m.items()) + " END"
SCR_NAME_SQL = f"""WITH k AS (SELECT p_partkey, {", ".join(f"{_sql_norm(x)} AS {x}" for x in ("g1", "g2", "f1", "f2", "b1", "b2", "m1"))} FROM (SELECT {", ".join(_PEOPLE)} FROM part)),
 n AS (SELECT *, CASE WHEN b1 <> '' THEN b1 ELSE f1 END AS own FROM k),
 c AS (SELECT *, g1 = g2 AS exact, coalesce({_sql_map("g1", _CLUSTER)} = {_sql_map("g2", _CLUSTER)}, false) AS variant, b2 <> '' AND b2 = own AS born, m1 <> '' AND f2 = m1 AS married,
  NOT (b2 <> '' AND b2 = own) AND f2 = own AS same, {_sql_map("f2", _CODE)} = {_sql_map("own", _CODE)} AS sound FROM n),
 x AS (SELECT *, sound AND NOT born AND NOT married AND NOT same AS bysound, born OR married OR same AS role,
  CASE WHEN exact THEN 10 WHEN variant THEN 8 ELSE 0 END AS given FROM c),
 y AS (SELECT *, role AND exact AND f1 = f2 AND (b1 = '' OR b2 = '' OR b1 = b2) AS whole, CASE WHEN born THEN 20 ELSE 0 END + CASE WHEN married THEN 15 WHEN same THEN 10 WHEN bysound THEN 8 ELSE 0 END AS family FROM x)
 SELECT p_partkey, CAST(least(45, greatest(given + family, CASE WHEN whole THEN 40 ELSE 0 END)) AS INT) AS name_score,
 array_to_string(list_filter([CASE WHEN exact THEN 'given name exact' WHEN variant THEN 'given name variant' END, CASE WHEN born THEN 'birth surname matches' END, CASE WHEN married THEN 'married name matches' END,
 CASE WHEN same AND NOT married THEN 'surname matches birth name' END, CASE WHEN bysound THEN 'surname phonetic' END, CASE WHEN NOT role AND NOT bysound THEN 'no surname role matched' END,
 CASE WHEN whole THEN 'full name exact' END], lambda r: r IS NOT NULL), '; ') AS reasons FROM y"""


# ---- text ----
def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of all documents with their number: counted first, so that each form is worked out once a token."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n]+")).alias("token"))
    return words.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def str_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select(T.normalize(F.col("token")).alias("normal"), "n").groupBy("normal").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


_TOKENS_SQL = "t AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n]+')) AS token FROM documents) WHERE token <> '' GROUP BY token)"
# Written out here, not read from the functions under test.
_WORDS = "'dr.', 'dr', 'prof.', 'prof', 'ing.', 'ing', 'pfarrer', 'dipl.', 'dipl', 'geb.', 'geb', 'geborene', 'gebuertige', 'geburtige', 'verw.', 'verw', 'verh.', 'verh', 'genannt', 'gen.', 'gen'"
_DOTTED = "dr|prof|ing|dipl|geb|verw|verh|gen"
_ACCENTED, _PLAIN = "áàâãåÁÀÂÃÅéèêëÉÈÊËíìîïÍÌÎÏóòôõÓÒÔÕúùûÚÙÛçÇñÑ", "aaaaaaaaaaeeeeeeeeiiiiiiiioooooooouuuuuuccnn"


def _sql_tidy(c: str, umlauts: dict[str, str]) -> str:
    c = f"translate({c}, '{_ACCENTED}', '{_PLAIN}')"
    for a, b in umlauts.items():
        c = f"replace({c}, '{a}', '{b}')"
    return f"CASE WHEN lower({c}) IN ({_WORDS}) THEN '' ELSE regexp_replace(lower({c}), '^(?:{_DOTTED})\\.(.)', '\\1') END"


_CANON = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
_COARSE = {"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "Ä": "a", "Ö": "o", "Ü": "u"}
STR_NORMALIZE_SQL = f"WITH {_TOKENS_SQL}, x AS (SELECT {_sql_tidy('substring(token, 1, 512)', _CANON)} AS normal, n FROM t) SELECT normal, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_forms FROM x GROUP BY normal"


def phn_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).select(T.phonetic(F.col("token")).alias("code"), "n")
    return rows.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


STRIPPED_SQL = f"regexp_replace(regexp_replace({_sql_tidy('substring(token, 1, 512)', _COARSE)}, '([aou])e', '\\1', 'g'), '[^a-z]', '', 'g')"
PHN_GROUPS_SQL = f"""WITH {_TOKENS_SQL}, s AS (SELECT {STRIPPED_SQL} AS s, n FROM t),
 c AS (SELECT string_split(s, '') AS c, n FROM s),
 k AS (SELECT n, array_to_string(list_transform(CASE WHEN c = [''] THEN [] ELSE c END, lambda x, i: CASE WHEN x IN ('a','e','i','j','o','u','y') THEN '0' WHEN x = 'b' THEN '1' WHEN x = 'p' THEN CASE WHEN c[i + 1] = 'h' THEN '3' ELSE '1' END
  WHEN x IN ('d','t') THEN CASE WHEN c[i + 1] IN ('c','s','z') THEN '8' ELSE '2' END WHEN x IN ('f','v','w') THEN '3' WHEN x IN ('g','k','q') THEN '4'
  WHEN x = 'c' THEN CASE WHEN i = 1 THEN CASE WHEN c[2] IN ('a','h','k','l','o','q','r','u','x') THEN '4' ELSE '8' END WHEN c[i - 1] IN ('s','z') THEN '8' WHEN c[i + 1] IN ('a','h','k','o','q','u','x') THEN '4' ELSE '8' END
  WHEN x = 'x' THEN CASE WHEN i > 1 AND c[i - 1] IN ('c','k','q') THEN '8' ELSE '48' END WHEN x = 'l' THEN '5' WHEN x IN ('m','n') THEN '6' WHEN x = 'r' THEN '7' WHEN x IN ('s','z') THEN '8' ELSE '' END), '') AS k FROM c),
 u AS (SELECT n, string_split(k, '') AS l FROM k),
 o AS (SELECT n, array_to_string(list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x), '') AS o FROM u),
 z AS (SELECT n, o[1:1] || replace(o[2:], '0', '') AS code FROM o)
 SELECT code, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_forms FROM z GROUP BY code"""


# ---- URLs ----
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", U.identity(url).alias("identity"), U.canonical_host(url).alias("host"), U.row_key(url).alias("row_key"))


_ID_SQL = r"""i AS (SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS s, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p,
 list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid|mc_eid)(=|$)'))) AS q FROM pages),
u AS (SELECT page_id, h, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS identity FROM i)"""
URL_IDENTITY_SQL = f"WITH {_ID_SQL} SELECT page_id, identity, nullif(regexp_replace(h, '^www\\.', ''), '') AS host, sha256(identity) AS row_key FROM u"


def stm_url_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one identity count once, the last wins."""
    rows = table(spark, d, "pages").select("page_id", U.identity(F.col("url")).alias("identity"), "url")
    return stores.last_wins(rows.select("identity", "page_id", "url"), ["identity"], "page_id")


STM_URL_GROUPS_SQL = f"WITH {_ID_SQL} SELECT identity, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM u JOIN pages USING (page_id) GROUP BY identity"

# ---- dates ----
_DATE_TEXT = "CASE o_orderkey % 7 WHEN 0 THEN {d} || '.' || {m} || '.' || {y} WHEN 1 THEN {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') WHEN 2 THEN {m} || '.' || {y} WHEN 3 THEN {y} WHEN 4 THEN '31.2.' || {y} WHEN 5 THEN '' ELSE 'around ' || {y} END"
_S = lambda part: f"CAST({part}(o_orderdate) AS {{}})"


def prs_dates(spark: SparkSession, d: str) -> DataFrame:
    text = _DATE_TEXT.format(**{k[0]: _S(k).format("STRING") for k in ("day", "month", "year")})
    rows = spread(table(spark, d, "orders").selectExpr("o_orderkey", f"{text} AS raw"), "o_orderkey").withColumn("r", D.parse_date(F.col("raw")))
    return rows.select("o_orderkey", F.col("r.status").alias("status"), F.col("r.precision").alias("precision"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), D.iso_to_gedcom(F.col("raw")).alias("gedcom"))


PRS_DATES_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(day(last_day(o_orderdate)) AS INT) AS e FROM orders)
 SELECT o_orderkey, CASE WHEN k <= 3 THEN 'known' WHEN k = 5 THEN 'unknown' ELSE 'invalid' END AS status, CASE WHEN k <= 1 THEN 'exact' WHEN k = 2 THEN 'month' WHEN k = 3 THEN 'year' ELSE 'open' END AS precision,
 CAST(CASE WHEN k <= 1 THEN y * 10000 + m * 100 + d WHEN k = 2 THEN y * 10000 + m * 100 + 1 WHEN k = 3 THEN y * 10000 + 101 END AS INT) AS lo,
 CAST(CASE WHEN k <= 1 THEN y * 10000 + m * 100 + d WHEN k = 2 THEN y * 10000 + m * 100 + e WHEN k = 3 THEN y * 10000 + 1231 END AS INT) AS hi,
 CASE WHEN k = 1 THEN d || ' ' || ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'][m] || ' ' || y END AS gedcom FROM o"""


# ---- coverage, memory, states, candidates ----
_COVERAGE = [
    "user_id",
    "event_type AS portal",
    "CASE WHEN value < 20 THEN 'skipped' WHEN value < 40 THEN 'failed' ELSE 'ok' END AS status",
    "CASE WHEN value > 90 THEN CAST(floor(value) AS INT) END AS notice_count",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS message",
    "event_id AS seq",
]


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*_COVERAGE)


def agg_outcome(spark: SparkSession, d: str) -> DataFrame:
    return stores.search_outcome(_coverage(spark, d), ["user_id"])


AGG_OUTCOME_SQL = f"WITH c AS (SELECT {", ".join(_COVERAGE)} FROM events) SELECT user_id, CASE WHEN coalesce(sum(notice_count) FILTER (status = 'ok'), 0) > 0 THEN 'found' WHEN bool_or(status = 'failed') THEN 'portal_failed' WHEN bool_or(status = 'ok') THEN 'no_notices' ELSE 'skipped' END AS outcome FROM c GROUP BY user_id"


def agg_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stores.merge_coverage(_coverage(spark, d), ["user_id"])


AGG_COVERAGE_SQL = f"""WITH c AS (SELECT {", ".join(_COVERAGE)} FROM events), g AS (SELECT user_id, portal, bool_or(status = 'ok') AS ok, bool_or(status = 'failed') AS failed, max(notice_count) FILTER (status = 'ok') AS n,
 arg_min(message, seq) FILTER (status = 'failed' AND message IS NOT NULL) AS m FROM c GROUP BY ALL)
 SELECT user_id, portal, CASE WHEN ok THEN 'ok' WHEN failed THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN ok THEN n END AS notice_count, CASE WHEN NOT ok AND failed THEN m END AS message FROM g"""

NOW = 1_706_659_200


def flt_suppressed(spark: SparkSession, d: str) -> DataFrame:
    memory = table(spark, d, "events").select("user_id", F.col("event_type").alias("signature"), F.unix_timestamp("ts").alias("recorded_at"))
    return stores.suppressed(memory, ["user_id"], "signature", "recorded_at", NOW, 86_400)


FLT_SUPPRESSED_SQL = f"SELECT DISTINCT user_id, event_type AS signature FROM events WHERE {NOW} - CAST(floor(epoch(ts)) AS BIGINT) < 86400"


def snk_replay(spark: SparkSession, d: str) -> DataFrame:
    """Status of each user's match after its events in order."""
    names = {"signup": "upsert", "view": "uncertain", "click": "confirm", "error": "reject", "purchase": "revert"}
    event = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")]
    return stores.replay(table(spark, d, "events").select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("row_key"), "event_id", event.alias("event")), ["row_key"], ["event_id"], "event")


def jn_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a finished order (death) who have an order (birth) of an early year."""
    people, orders = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders")
    deaths = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300_000)).select(F.col("o_custkey").alias("c_custkey"))
    births = orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("born"))
    return stores.select_candidates(people, deaths, births, "c_custkey", "born", 2085, 90)


JN_CANDIDATES_SQL = "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) BETWEEN 1 AND 1995)"

_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'uncertain' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'pending' END END"


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS person_id", "o_orderkey", f"{_STATUS_SQL} AS status", "CAST(floor(o_totalprice / 5000) AS INT) AS score")


def agg_worklist_counts(spark: SparkSession, d: str) -> DataFrame:
    return stores.worklist_counts(_matches(spark, d))


AGG_COUNTS_SQL = f"WITH m AS (SELECT {_STATUS_SQL} AS s FROM orders) SELECT count(*) AS total, count(*) FILTER (s IN ('pending', 'uncertain')) AS open, count(*) FILTER (s = 'confirmed') AS confirmed, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'uncertain') AS uncertain FROM m"


def open_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).where("status in ('pending', 'uncertain')")


def srt_worklist_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of open matches, best score first, ties by person and key."""
    return stores.page(open_matches(spark, d), [F.desc("score"), F.asc("person_id"), F.asc("o_orderkey")], 2)


SRT_PAGE_SQL = f"WITH m AS (SELECT CAST(o_custkey AS VARCHAR) AS person_id, o_orderkey, {_STATUS_SQL} AS status, CAST(floor(o_totalprice / 5000) AS INT) AS score FROM orders) SELECT * FROM m WHERE status IN ('pending', 'uncertain') ORDER BY score DESC, person_id, o_orderkey LIMIT 50 OFFSET 50"


def snk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored matches merged with new ones: terminal rows stay."""
    old = _matches(spark, d)
    new = old.select((F.col("o_orderkey") + 1).alias("o_orderkey"), "person_id", "status", (F.col("score") + 1).alias("score"))
    return stores.upsert_pending(old, new, ["o_orderkey"])


_KEPT = "(coalesce(o.status IN ('confirmed', 'rejected'), false) OR n.o_orderkey IS NULL)"
SNK_UPSERT_SQL = f"""WITH m AS (SELECT CAST(o_custkey AS VARCHAR) AS person_id, o_orderkey, {_STATUS_SQL} AS status, CAST(floor(o_totalprice / 5000) AS INT) AS score FROM orders)
 SELECT coalesce(o.o_orderkey, n.o_orderkey + 1) AS o_orderkey, CASE WHEN {_KEPT} THEN o.person_id ELSE n.person_id END AS person_id, CASE WHEN {_KEPT} THEN o.status ELSE 'pending' END AS status, CASE WHEN {_KEPT} THEN o.score ELSE n.score + 1 END AS score
 FROM m o FULL JOIN m n ON o.o_orderkey = n.o_orderkey + 1"""


def str_query_hints(spark: SparkSession, d: str) -> DataFrame:
    """Search hints for a person derived from each part, one row each."""
    name = F.struct(F.array("g1").alias("given_names"), F.col("g2").alias("call_name"), F.col("f1").alias("surname"), F.col("b1").alias("birth_surname"), F.array_compact(F.array("m1")).alias("married_surnames"))
    rows = _people(spark, d).select("p_partkey", F.posexplode(T.query_hints(name, (F.lit(1900) + F.col("p_size")).cast("string"), F.lit("Bonn"))).alias("pos", "hint"))
    return rows.select("p_partkey", "pos", "hint.query", "hint.priority")


QUERIES = {
    "scr_dates": scr_dates, "win_classify": win_classify, "scr_name": scr_name, "str_normalize": str_normalize, "phn_groups": phn_groups, "url_identity": url_identity, "stm_url_groups": stm_url_groups, "prs_dates": prs_dates,
    "agg_outcome": agg_outcome, "agg_coverage": agg_coverage, "flt_suppressed": flt_suppressed, "snk_replay": snk_replay, "jn_candidates": jn_candidates, "agg_worklist_counts": agg_worklist_counts, "srt_worklist_page": srt_worklist_page,
    "snk_upsert": snk_upsert, "str_query_hints": str_query_hints,
}
ORACLE_SQL = {
    "scr_dates": SCR_DATES_SQL, "win_classify": WIN_CLASSIFY_SQL, "scr_name": SCR_NAME_SQL, "str_normalize": STR_NORMALIZE_SQL, "phn_groups": PHN_GROUPS_SQL, "url_identity": URL_IDENTITY_SQL, "stm_url_groups": STM_URL_GROUPS_SQL, "prs_dates": PRS_DATES_SQL,
    "agg_outcome": AGG_OUTCOME_SQL, "agg_coverage": AGG_COVERAGE_SQL, "flt_suppressed": FLT_SUPPRESSED_SQL, "jn_candidates": JN_CANDIDATES_SQL, "agg_worklist_counts": AGG_COUNTS_SQL, "srt_worklist_page": SRT_PAGE_SQL, "snk_upsert": SNK_UPSERT_SQL,
}
QUERIES |= _review.QUERIES
ORACLE_SQL |= _review.ORACLE_SQL
