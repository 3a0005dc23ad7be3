import hashlib
import json

from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators import review
from kinfold.plans import review as plans
from kinfold.sources.responses import read_bodies, validate

SF = "/root/testdata/sf0.001"
NOTICE = {"name": "Anna Schmidt geb. Becker", "url": "https://a.de/1", "fetchedAt": "2024-03-12T10:00:00Z", "death": "12.03.2024", "age": 86, "relatives": [{"name": "Karl", "relationGuess": "spouse", "confidence": 0.9}, {"name": 3}]}
PORTAL = {"portal": "p", "status": "ok", "noticeCount": 1}


def body(**k):
    return json.dumps({"schemaVersion": 1, "jobId": "j", "state": "done", "results": {"1": {"notices": [NOTICE], "coverage": [PORTAL]}}} | k)


def one(notice=None, portal=None):
    return body(results={"1": {"notices": [NOTICE | (notice or {})], "coverage": [PORTAL | (portal or {})]}})


CASES = [
    (body(), None), (None, "body_invalid"), ("[]", "body_invalid"), ("{", "body_invalid"), (body(state="running"), "not_done"), (body(state="failed"), "finder_failed"), (body(state=None), "state_invalid"),
    (body(schemaVersion="1"), "schema_version"), (body(schemaVersion=2), "schema_version"), (body(jobId="x"), "job_id"), (body(results=[1]), "results_not_object"), (body(results=[]), None), (body(results={}), None),
    (body(results={"9": {"notices": [], "coverage": []}}), "person_not_requested"), (body(results={"1": []}), "result_not_object"), (body(results={"1": {"notices": {}, "coverage": []}}), "notices_not_list"),
    (body(results={"1": {"notices": [], "coverage": {}}}), "coverage_not_list"), (body(results={"1": {"notices": [], "coverage": []}}), None), (body(results={"1": {"notices": [1], "coverage": []}}), "notice_not_object"),
    (one({"url": 3}), "url_missing"), (one({"url": "//evil.host/x"}), "url_scheme"), (one({"fetchedAt": "2024-02-30T10:00:00Z"}), "fetched_at"), (one({"fetchedAt": "2024-00-00T10:00:00Z"}), "fetched_at"), (one({"fetchedAt": "now"}), "fetched_at"), (one({"fetchedAt": "2024-03-12T10:00:00Z\n"}), "fetched_at"),
    (one(None, {"portal": " "}), "coverage_portal"), (one(None, {"status": "up"}), "coverage_status"), (one(None, {"noticeCount": -1}), "coverage_count"), (one(None, {"noticeCount": 1.5}), "coverage_count"),
    (one(None, {"message": "x" * 1001}), "coverage_message"), (one(None, {"message": 3}), "coverage_message"), (one(None, {"message": "x" * 1000, "noticeCount": None}), None),
]


def responses(spark, bodies):
    return spark.createDataFrame([("j", ["1"], b, i) for i, b in enumerate(bodies)], "job_id string, requested_person_ids array<string>, body string, i int")


def test_refused_responses(spark):
    got = {r.i: r.reason for r in validate(responses(spark, [b for b, _ in CASES])).jobs.collect()}
    assert [got[i] for i in range(len(CASES))] == [why for _, why in CASES]


def test_dropped_and_defaulted_notices(spark):
    bodies = [one({"name": " "}), one({"name": 3}), one({"disposition": "sea"}), one({"disposition": 3}), one({"disposition": "cremation", "age": "3", "noticeType": "zz", "source": 3}), one({"parsedName": {"surname": "Alt", "givenNames": ["A", 3]}}), one({"parsedName": {"surname": "", "givenNames": []}, "disposition": None})]
    v = validate(responses(spark, bodies))
    assert v.jobs.where("route = 'completed'").count() == len(bodies) and v.coverage.count() == len(bodies)
    got = sorted((r.disposition, r.parsed_name.surname, r.parsed_name.birth_surname or "", r.age or -1, r.notice_type, r.source, len(r.relatives), r.death.lo) for r in v.notices.collect())
    assert got == [("burial", "Alt", "", 86, "obituary", "", 1, 20240312), ("burial", "Schmidt", "Becker", 86, "obituary", "", 1, 20240312), ("cremation", "Schmidt", "Becker", -1, "obituary", "", 1, 20240312)]


def test_empty_table(spark):
    v = validate(responses(spark, ["{}"]).limit(0))
    assert v.jobs.count() == v.notices.count() == v.coverage.count() == 0


def test_bodies(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"a": 1}')
    assert [r.body for r in read_bodies(spark, str(tmp_path)).collect()] == ['{\n"a": 1}']


def test_gate_and_signature(spark):
    rows = spark.createDataFrame([(True, True, None, 0), (None, True, "x", 1), (None, None, "2024-02-30", 2), (False, False, "2024-03-12", 3)], "h boolean, t boolean, d string, i int")
    got = rows.orderBy("i").select(review.confirm_gate(F.col("h"), F.col("t"), F.col("d")).alias("g")).collect()
    assert [r.g for r in got] == ["hard_conflict", "tree_already_has_death_date", "no_exact_death_date", None]
    none = F.lit(None)
    s = lambda *p: review.search_signature(F.array(F.lit("Käthe")), F.lit("Weiß"), none.cast("string"), none, F.array(*map(F.lit, p)), none.cast("string"))
    r = spark.range(1).select(s("Bonn", "Köln").alias("a"), s("koeln", "bonn", "Bonn").alias("b"), s("Bonn").alias("c"), review.search_signature(none.cast("array<string>"), F.lit(""), F.lit(""), none, none.cast("array<string>"), F.lit("")).alias("e")).first()
    assert r.a == r.b != r.c and len(r.e) == 64
    name = F.struct(F.array(F.lit(" ")).alias("given_names"), F.lit("").alias("surname"), none.cast("string").alias("birth_surname"), none.cast("array<string>").alias("married_surnames"), F.array(F.lit(" "), none).alias("aliases"))
    assert spark.range(1).select(review.searchable(name).alias("x")).first().x is False


def test_signature_bytes(spark):
    """As a JSON writer that escapes slashes and all but ASCII: slashes, backslashes before a u, letters beyond the first plane, quotes, no year."""
    rows = [(["Łucja", "a\\\\u00C9x"], "O/Neil", None, 1934, ["Ænes", "b\\\\", "B/c"], "ж𝔘\"\\x01"), ([], "", "", None, [], None)]
    df = spark.createDataFrame(rows, "g array<string>, s string, b string, y int, p array<string>, r string")
    strip = lambda c: T.strip(F.col(c))
    folded = df.select(F.transform("g", T.strip).alias("g"), strip("s").alias("s"), strip("b").alias("b"), "y", F.array_sort(F.array_distinct(F.transform("p", T.strip))).alias("p"), strip("r").alias("r")).collect()
    got = df.select(review.search_signature(*(F.col(c) for c in "gsbypr")).alias("x")).collect()
    for r, x in zip(folded, got, strict=True):
        body = {"given": r.g, "surname": r.s, "birthSurname": r.b, "birthYear": r.y, "places": r.p, "region": r.r}
        assert x.x == hashlib.sha256(json.dumps(body, separators=(",", ":")).replace("/", "\\/").encode()).hexdigest(), body


def test_no_python_in_plans(spark):
    for name in plans.QUERIES:
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct")), name
