import pytest
from compare import same_rows
from pyspark.sql import functions as F

from kinfold.functions import dates, text, urls
from kinfold.operators import ranking, scoring, stores
from kinfold.plans import queries

SF = "/root/testdata/sf0.001"


def values(spark, f, xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_normalize(spark):
    given = ["Müller", "Weiß", "Dr. Anna Schmidt", "anna geb.becker", "geb.", "Łukasz", "prof.dr.x", None, ""]
    assert values(spark, text.normalize, given) == ["mueller", "weiss", "anna schmidt", "anna becker", "", "łukasz", "dr.x", "", ""]
    assert values(spark, text.strip, ["Müller", "Mueller", "Muller", "ÖZGÜR"]) == ["muller", "muller", "muller", "ozgur"]


def test_phonetic(spark):
    given = ["Müller", "Meyer", "Maier", "Mayer", "Schmidt", "Schmitt", "rjr", "lyl", "Johann", "Yohann", "Bad", "Rat", "", None]
    assert values(spark, text.phonetic, given) == ["657", "67", "67", "67", "862", "862", "77", "55", "06", "06", "12", "72", "", ""]


def test_parse_name(spark):
    got = values(spark, text.parse_name, ["Anna Schmidt geb. Becker", "Erika (geb. Weiß) Muster", "Anna geb. geborene Roth Berg", "Maria Alt verw. Neu", "", None])
    assert [(r.given_names, r.surname, r.birth_surname) for r in got] == [(["Anna"], "Schmidt", "Becker"), (["Erika"], "Muster", "Weiß"), (["Anna"], "Berg", "Roth"), (["Maria"], "Alt", None), ([], "", None), ([], "", None)]


def test_dates(spark):
    got = values(spark, dates.parse_date, ["02.08.1962", "2.8.1962", "02. 08. 1962", "1962-08-02", "1962", "08.1962", "", "31.2.2020", "0000", None])
    assert [(r.lo, r.hi, r.precision, r.status) for r in got] == [*[(19620802, 19620802, "exact", "known")] * 4, (19620101, 19621231, "year", "known"), (19620801, 19620831, "month", "known"), (None, None, "open", "unknown"), (None, None, "open", "invalid"), (None, None, "open", "invalid"), (None, None, "open", "unknown")]
    assert values(spark, dates.iso_to_gedcom, ["2024-03-12", "2024-02-30", None]) == ["12 MAR 2024", None, None]


def test_urls(spark):
    given = ["HTTPS://Example.ORG:443/a%7eb?utm_source=x&b=2&a=1#top", "http://u:p@example.org", "not a url", "http://x.org/%zz%2f", None]
    assert values(spark, urls.identity, given) == ["https://example.org/a~b?a=1&b=2", "http://example.org/", "not a url", "http://x.org/%zz%2F", None]
    assert values(spark, urls.canonical_host, ["https://www.a.de/x", "ftp://a.de", "https://a\x01.de", "http://www./"]) == ["a.de", None, None, None]


def test_name_and_relative_scores(spark):
    rows = spark.sql("""SELECT named_struct('given_names', array('Elise'), 'surname', 'Müller', 'birth_surname', 'Schmidt', 'married_surnames', array('Müller')) AS person,
        named_struct('given_names', array('Elisabeth'), 'surname', 'Mueller', 'birth_surname', 'Schmidt', 'married_surnames', CAST(array() AS array<string>)) AS notice""")
    rows = scoring.with_keys(scoring.with_keys(rows, "person", "c"), "notice", "n")
    assert rows.select(scoring.name_score(scoring.ScoreConfig())["score"].alias("s")).first().s == 43
    rows = spark.sql("""SELECT array(named_struct('id', 'I2', 'given', array('karl'), 'surname', 'muster')) AS s, array(named_struct('id', 'I3', 'given', array('eva'), 'surname', 'muster')) AS c,
        array(named_struct('given', array('karl'), 'surname', 'muster', 'confidence', 0.5D), named_struct('given', array('eva'), 'surname', 'muster', 'confidence', 1D), named_struct('given', array('karl'), 'surname', 'muster', 'confidence', 1D)) AS r""")
    assert rows.select(scoring.relative_score(scoring.ScoreConfig.enriched(), F.col("s"), F.col("c"), F.col("r"))["score"].alias("s")).first().s == 25


def test_ambiguity_is_strict(spark):
    rows = spark.createDataFrame([("a", 1, 90, False), ("a", 2, 80, False), ("b", 1, 90, False), ("b", 2, 81, False), ("c", 1, 90, True)], "n string, i int, t int, h boolean")
    got = {(r.n, r.i): (r.band, r.ambiguous) for r in ranking.classify(rows, "n", "t", "h", "i").collect()}
    assert got["a", 1] == ("strong", False) and got["b", 1] == ("strong", True) and got["c", 1] == ("possible", False)


def test_replay(spark):
    steps = [("k1", 1, "upsert"), ("k1", 2, "confirm"), ("k1", 3, "reject"), ("k1", 4, "revert"), ("k2", 1, "confirm"), ("k3", 1, "reject"), ("k3", 2, "upsert"), ("k4", 1, "upsert"), ("k4", 2, "uncertain"), ("k4", 3, "upsert")]
    rows = stores.replay(spark.createDataFrame(steps, "k string, i int, e string"), ["k"], ["i"], "e")
    assert {r.k: r.status for r in rows.collect()} == {"k1": "pending", "k2": None, "k3": "rejected", "k4": "pending"}


def test_no_python_in_plans(spark):
    for name in ("scr_dates", "win_classify", "scr_name", "str_normalize", "phn_groups", "url_identity"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin")), name
