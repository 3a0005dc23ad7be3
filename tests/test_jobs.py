import pytest
from compare import same_rows

from kinfold.operators import ledger
from kinfold.plans import jobs

SF = "/root/testdata/sf0.001"
LEDGER = "job_id string, tree_id int, requested_person_ids array<string>, claimed_at long"
EVENTS = "job_id string, at long, seq long, event string, tree_id int, requested_person_ids array<string>"


@pytest.mark.parametrize("name", sorted(jobs.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(spark, jobs.QUERIES[name], jobs.ORACLE_SQL[name], SF)


def test_life_of_a_job(spark):
    known = spark.createDataFrame([("old", 1, ["I1"], 100), ("kept", 2, None, None)], LEDGER)
    steps = [
        ("a", 10, 0, "claim", None, None), ("a", 11, 0, "record", 1, ["I1"]), ("a", 12, 0, "claim", None, None), ("a", 12, 1, "claim", None, None), ("a", 13, 0, "release", None, None), ("a", 14, 0, "release", None, None),
        ("old", 3699, 0, "claim", None, None), ("old", 3700, 0, "claim", None, None), ("old", 3800, 0, "remove", None, None), ("old", 3801, 0, "remove", None, None),
        ("big", 1, 0, "record", 1, ["I" * 70_000]), ("big", 2, 0, "claim", None, None), ("../x", 1, 0, "record", 1, []), (None, 1, 0, "record", 1, []), ("odd", 1, 0, None, None, None),
    ]
    got = {r.job_id: (r.held, r.claimed_at, r.requested_person_ids, r.outcomes) for r in ledger.replay(known, spark.createDataFrame(steps, EVENTS)).collect()}
    assert got == {
        "a": (True, None, ["I1"], ["lost", "recorded", "claimed", "lost", "released", "unchanged"]), "old": (False, None, ["I1"], ["lost", "claimed", "removed", "unchanged"]), "kept": (True, None, None, []),
        "big": (False, None, None, ["refused", "lost"]), "../x": (False, None, None, ["refused"]), None: (False, None, None, ["refused"]), "odd": (False, None, None, ["unchanged"]),
    }


def test_empty_and_limits(spark):
    none = spark.createDataFrame([], LEDGER)
    assert ledger.replay(none, spark.createDataFrame([], EVENTS)).count() == 0
    fetched, trees = spark.createDataFrame([("b", "completed"), ("b", "completed"), ("a", "failed"), ("c", "completed"), ("d", "retry")], "job_id string, route string"), spark.createDataFrame([(1,), (1,), (2,)], "tree_id int")
    held = spark.createDataFrame([(j, t, [], c) for j, t, c in (("a", 1, None), ("b", 1, 1), ("c", 2, None), ("d", 1, None), ("e", 1, None))], LEDGER)
    take = lambda limit, tree=None, now=3601: [(r.job_id, r.action) for r in ledger.take(held, fetched, now, limit, trees, tree).collect()]
    assert take(0) == take(-1) == [] and take(2) == [("a", "failed"), ("b", "ingest")] and take(9, 1) == [("a", "failed"), ("b", "ingest"), ("c", "release")] and take(9, 1, 3600) == [("a", "failed"), ("c", "release")]
    assert ledger.take(none, fetched, 1, 9, trees).count() == 0 and tuple(ledger.summary(ledger.take(none, fetched, 1, 9, trees), none, 1).first()) == (0, 0, 0, 0)
    assert {r.job_id for r in ledger.entries(held.drop("claimed_at"), spark.createDataFrame([("x/y", 1, [], 1), ("z", 1, [], 1)], LEDGER)).collect()} == {*"abcdez"}
