import json

import pytest
from compare import same_rows
from pyspark.sql import functions as F

from kinfold.functions import text
from kinfold.operators import enqueue, ingest, review, scoring, stores, worklist
from kinfold.plans import matching, queries, tree
from kinfold.sources import responses, settings
from kinfold.sources import tree as T

SF = "/root/testdata/sf0.001"
STORED = "person_id string, row_key string, url string, status string, reason string, match string, write_back string, origin string"
ALL = queries.QUERIES | matching.QUERIES | tree.QUERIES
PERSON = "person_id string, name struct<given_names:array<string>,surname:string,birth_surname:string,married_surnames:array<string>,aliases:array<string>>, gender string, birth struct<lo:int,hi:int,precision:string,status:string,original:string>, birth_place struct<name:string,region:string,aliases:array<string>>, places array<struct<name:string,region:string,aliases:array<string>>>, tree_death struct<lo:int,hi:int,precision:string,status:string,original:string>, spouses array<struct<id:string,name:struct<given_names:array<string>,surname:string>>>, children array<struct<id:string,name:struct<given_names:array<string>,surname:string>>>, signature string"
EXACT, UNKNOWN = (19340802, 19340802, "exact", "known", None), (None, None, "open", "unknown", None)


@pytest.mark.parametrize("name", sorted(matching.ORACLE_SQL | tree.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(spark, ALL[name], (matching.ORACLE_SQL | tree.ORACLE_SQL)[name], SF)


def people(spark):
    home = [("Bonn, Rheinland", "Hessen", None)]
    rows = [
        ("I1", (["Elisabeth"], "Müller", "Schmidt", ["Müller"], None), "female", EXACT, None, home, UNKNOWN, [("I2", (["Karl"], "Müller"))], [("I3", (["Eva"], "Müller"))], "s1"),
        ("I2", (None, None, None, None, None), None, UNKNOWN, None, None, UNKNOWN, None, None, None),
    ]
    return spark.createDataFrame(rows, PERSON)


def body(job, person="I1", url="https://a.de/1", notices=1, **more):
    notice = {"name": "Elise Müller geb. Schmidt", "birth": "02.08.1934", "death": "2024-03-09", "place": "Bonn", "cemetery": "Friedhof Bonn", "age": 89, "url": url, "fetchedAt": "2024-03-12T10:00:00Z", "relatives": [{"name": "Karl Müller", "relationGuess": "spouse", "confidence": 0.9}]} | more
    return json.dumps({"schemaVersion": 1, "jobId": job, "state": "done", "results": {person: {"notices": [notice] * notices, "coverage": [{"portal": "p", "status": "ok", "noticeCount": notices}, {"portal": "q", "status": "failed"}]}}})


def test_ingest_of_a_response(spark):
    rows = spark.createDataFrame([("j", ["I1"], body("j"))], "job_id string, requested_person_ids array<string>, body string")
    v = responses.validate(rows)
    got = ingest.ingest(v.notices, v.coverage, people(spark), spark.createDataFrame([], STORED))
    r = got.matches.first()
    account = json.loads(r.match)
    assert (r.person_id, r.status, account["classification"], account["hardConflict"]) == ("I1", "pending", "strong", False)
    assert {k: s["score"] for k, s in account["signals"].items()} == {"name": 35, "birth": 25, "place": 10, "plausibility": 10, "relatives": 23, "age": 20, "cemetery": 10, "conflicts": 0}
    assert account["score"] == 100 and account["extractedFacts"] == {"deathDate": "2024-03-09", "cemetery": "Friedhof Bonn"} and account["noticeRelatives"][0]["name"] == "Karl Müller" and account["runnerUp"] is None
    assert got.counters.first().asDict() == {"notices_read": 1, "candidates_found": 2, "matches_stored": 1, "warnings": 1}
    assert [tuple(w) for w in got.warnings.collect()] == [("I1", "portal_failed", "q", 1)]


def test_ingest_of_nothing(spark):
    rows = spark.createDataFrame([], "job_id string, requested_person_ids array<string>, body string")
    v = responses.validate(rows)
    got = ingest.ingest(v.notices, v.coverage, people(spark).limit(0), spark.createDataFrame([], STORED))
    assert got.matches.count() == got.warnings.count() == 0 and set(got.counters.first()) == {0}


def test_timestamps_and_notice_types(spark):
    times = ["2024-03-12T23:59:59Z", "2024-03-12T24:00:00Z", "2024-03-12T23:59:60Z", "2024-03-12T10:00:60Z", "2024-02-30T10:00:00Z", "2024-03-12T10:60:00Z", "now", None]
    rows = spark.createDataFrame(list(enumerate(times)), "i int, t string").select("i", responses.valid_timestamp(F.col("t")).alias("ok")).orderBy("i")
    assert [r.ok for r in rows.collect()] == [True, False, False, True, False, False, False, False]
    kinds = ["obituary", "death_notice", "funeral_notice", "grave_memorial", "cemetery_record", "memorial", 7]
    rows = spark.createDataFrame([(str(k), ["I1"], body(str(k), noticeType=t)) for k, t in enumerate(kinds)], "job_id string, requested_person_ids array<string>, body string")
    assert [r.notice_type for r in responses.validate(rows).notices.orderBy("job_id").collect()] == [*kinds[:5], "obituary", "obituary"]


def test_place_and_cemetery_scores(spark):
    cfg = scoring.ScoreConfig.enriched()
    rows = people(spark).where("person_id = 'I1'").crossJoin(spark.createDataFrame([(k, x) for k, x in enumerate(["Bonn", "hessen", "Bonn, Rheinland", "", None, "Friedhof Bonner Straße", "Nordfriedhof Bonn", "Waldfriedhof Hessen"])], "i int, x string"))
    place, grave = scoring.place_score(cfg, F.col("places"), F.col("birth_place"), F.struct(F.col("x").alias("name"))), scoring.cemetery_score(cfg, F.col("places"), F.struct(F.col("x").alias("name")))
    got = [(r.p, r.c) for r in rows.select("i", place["score"].alias("p"), grave["score"].alias("c")).orderBy("i").collect()]
    assert got == [(10, 10), (8, 6), (0, 10), (0, 0), (0, 0), (0, 0), (0, 10), (0, 6)]


def test_decisions(spark):
    stored = spark.createDataFrame([("a", "pending", "old", None, "m"), ("b", "confirmed", None, "w", "m")], "k string, status string, reason string, write_back string, match string")
    steps = [("a", 1, "confirm", None, "w1"), ("a", 2, "reject", "r", None), ("a", 3, "revert", None, None), ("a", 4, "reject", "r", None), ("a", 5, "reject", "r", None), ("a", 6, "upsert", None, None), ("c", 1, "confirm", None, "w"), ("c", 2, "reject", "x", None), ("d", 1, "uncertain", "u", None)]
    rows = stores.decide(stored, spark.createDataFrame(steps, "k string, at int, event string, reason string, write_back string"), ["k"], ["at"])
    assert {r.k: (r.status, r.reason, r.write_back, r.match, r.outcomes) for r in rows.collect()} == {
        "a": ("rejected", "r", None, "m", ["confirmed", "refused", "reverted", "rejected", "unchanged", "kept"]), "b": ("confirmed", None, "w", "m", []),
        "c": ("rejected", "x", None, None, ["missing", "rejected"]), "d": (None, None, None, None, ["missing"]),
    }


def test_limit_of_none_and_ids(spark):
    some = people(spark).select("person_id", "name", "signature")
    none = spark.createDataFrame([], "person_id string, finder_id string, signature string, recorded_at long")
    got, counts = enqueue.select_eligible(some, none.select("person_id"), none, "f", 0, 1)
    assert got.count() == 0 and set(counts.first()) == {0}
    got, counts = enqueue.select_eligible(some, none.select("person_id"), none, "f", 5, 1)
    assert [r.person_id for r in got.collect()] == ["I1"] and tuple(counts.first()) == (1, 0, 0)
    row = spark.sql("SELECT timestamp'2024-03-12 10:00:00' AS t").select(enqueue.job_id(F.col("t"), F.lit("x")).alias("id"), enqueue.job_id(F.col("t"), F.lit("x")).rlike(review.SAFE_JOB_ID).alias("ok")).first()
    assert row.id.startswith("job-20240312T100000Z-") and row.ok
    total = enqueue.fan_out(spark.createDataFrame([("j2", 1, 2, 0), (None, 0, 1, 3), ("j1", 2, 0, 0)], "job_id string, eligible long, skipped long, suppressed long")).first()
    assert tuple(total) == (3, 3, 3, ["j1", "j2"])


def test_worklist_orders(spark):
    rows = spark.createDataFrame([("10", "a", "B", 5, None), ("2", "b", "A", 5, "2020-01-01"), ("3", "c", "C", 9, "2019-01-01")], "person_id string, row_key string, person_name string, score int, death_iso string")
    keys = {by: "".join(r.row_key for r in rows.orderBy(*worklist.order(by)).collect()) for by in ("score", "name", "death", "odd")}
    assert keys == {"score": "cab", "name": "bac", "death": "cba", "odd": "cab"}
    v = F.try_variant_get(F.parse_json(F.lit('[{"name":" Karl Alt ","relationGuess":" SON ","confidence":0.4},{"name":" "},7,{"name":"Eva","confidence":"1"}]')), "$", "array<variant>")
    got = spark.range(1).select(worklist.notice_relatives(v).alias("r")).first().r
    assert [tuple(r) for r in got] == [("Karl Alt", "son", True), ("Eva", "", True)]


def test_settings():
    given = {"name": "45", "birth": "999", "place": "x", "plausibility": "1234567890", "max_penalty": "", "ambiguity_gap": "٣"}
    cfg = settings.score_config(lambda k, default: given.get(k, default))
    assert (cfg.name, cfg.birth, cfg.place, cfg.plausibility, cfg.max_penalty, cfg.ambiguity_gap, cfg.relatives) == (45, 100, 10, 10, 50, 10, 35)


def test_call_name(spark):
    rows = spark.createDataFrame([("0 @I1@ INDI\n1 NAME A /B/\n2 _RUFNAME  Lisa \n2 _RUFNAME Eva",), ("1 NOTE _RUFNAME x",), (None,)], "r string")
    assert [r.c for r in rows.select(T.call_name(F.col("r")).alias("c")).collect()] == ["Lisa", None, None]


def test_hydrate_some(spark):
    """With ids the rows of those people are as without; call names come from records and go into hints, those of relatives as well; one without names has an empty one."""
    parts, records = tree._tree(spark, SF), tree._records(spark, SF)
    ids = spark.createDataFrame([("3",), ("4",), ("9",), ("10",), ("3",), ("none",)], "person_id string")
    pick = lambda df: sorted(map(str, df.select("person_id", "name", "places", "birth_place", "spouses", "children").collect()))
    some = T.hydrate(*parts, ids=ids, records=records)
    assert pick(some) == pick(T.hydrate(*parts, records=records).where("person_id in ('3', '4', '9')")) and some.count() == 3  # 10 is not visible
    rows = {r.person_id: r for r in some.withColumn("hints", text.query_hints(F.col("name"), F.lit("1934"), F.lit("Bonn"))).collect()}
    assert (rows["3"].name.call_name, rows["4"].name.call_name) == ("Eva3", None) and "Eva3 Alt3" in {h.query for h in rows["3"].hints}
    assert {m.name.call_name for m in rows["3"].spouses + rows["3"].children} == {None, "Eva2"}
    people_, names, facts, links = parts
    bare = T.hydrate(people_, names.where("person_id <> '4'"), facts, links, ids=ids, records=records).where("person_id = '4'").first()
    assert bare.name.given_names == [] and bare.name.surname == "" and bare.name.aliases == []


def test_an_alias_is_searchable_and_urls_have_hosts(spark):
    name = "struct<given_names:array<string>,surname:string,birth_surname:string,married_surnames:array<string>,aliases:array<string>>"
    rows = [(([" "], "", None, [], a),) for a in (["Lisl"], [" "], [], None)]
    got = spark.createDataFrame(rows, f"name {name}").select(review.searchable(F.col("name")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False]
    urls = {"https://[::1]:8080/x": True, "http://[fe80::1]": True, "https://host:99999": False, "https://host:65535/": True, "https://host:": True, "https://u@h.de": False, "https://[::1": False, "https:///x": False, "ftp://h.de": False, "HTTPS://h.de?x@y": True, "https://a b.de": False, "https://h.de:12a": False}
    rows = spark.createDataFrame([(u, None) for u in urls], "u string, t string")
    assert {r.u: r.ok for r in rows.select("u", settings.connectable(F.col("u"), F.col("t")).alias("ok")).collect()} == urls
