"""The drain: order over jobs, trees, origins, memory, keyed tables rewritten in part, replays."""

import json

import pytest
from pyspark.sql import functions as F
from test_matching import people

from kinfold.sources.keyed import KeyedStore, Table
from kinfold.streaming import drain as D


def notice(url="https://a.de/1", name="Elise Müller geb. Schmidt", **more):
    return {"name": name, "birth": "02.08.1934", "death": "2024-03-09", "url": url, "fetchedAt": "2024-03-12T10:00:00Z", **more}


def line(job, at, finder="f1", tree=1, person="I1", notices=(), status="ok", state="done", count=None):
    portal = {"portal": "p", "status": status, "noticeCount": len(notices) if count is None else count}
    body = {"schemaVersion": 1, "jobId": job, "state": state, "results": {person: {"notices": list(notices), "coverage": [portal]}}}
    return {"job_id": job, "tree_id": tree, "requested_person_ids": [person], "signature": "x", "finder_id": finder, "received_at": at, "body": json.dumps(body)}


def responses(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in D.RESPONSES.split(", ")) for r in rows], D.RESPONSES)


def known(spark):
    """I1 and I2 in tree 1, another I1 in tree 2."""
    one = people(spark).withColumn("signature", F.coalesce("signature", F.lit("s2")))
    return one.withColumn("tree_id", F.lit(1)).unionByName(one.where("person_id = 'I1'").withColumn("tree_id", F.lit(2)))


FIRST = [
    # The later job's notice counts, though it stands at an earlier place in its response; equal arrivals go by job id.
    line("j1", 10, notices=[notice("https://b.de/9", "Other"), notice(name="First Finder")]),
    line("j2", 20, "f2", notices=[notice("https://a.de/1?utm_source=x", "Second Finder")]),
    line("j3", 20, "f1", 2, notices=[notice(name="Other Tree")]),
    line("j4", 30, "f1", 1, "I2"),
    line("j5", 30, "f1", 9, notices=[notice()]),
    line("j6", 31, state="running"),
    line("j7", 32, "f2", 1, "I9", notices=[notice()]),
    line("j7", 33, "f2", 1, "I9"),
]
SECOND = [
    # A find by one finder forgets all finders' searches in vain, but not the one that comes after it.
    line("k1", 40, "f3", 1, "I2"),
    line("k2", 50, "f2", 1, "I2", notices=[notice("https://c.de/1")]),
    line("k3", 60, "f4", 1, "I2"),
    line("j1", 70, "f1", notices=[notice(name="Once More")]),
    line("k4", 80, "f1", 1, "I1", status="failed"),
]


def rows_of(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_batch_of_several_jobs(spark):
    got = D.drain_tables(responses(spark, FIRST), known(spark), trees=spark.createDataFrame([(1,), (2,)], "tree_id int"))
    assert rows_of(got.jobs, "job_id", "action", "notices_read", "candidates_found", "matches_stored", "warnings") == {
        ("j1", "ingest", 2, 1, 2, 0), ("j2", "ingest", 1, 1, 1, 0), ("j3", "ingest", 1, 1, 1, 0), ("j4", "ingest", 0, 1, 0, 0), ("j5", "unknown_tree", 0, 0, 0, 0), ("j6", "retry", 0, 0, 0, 0), ("j7", "ingest", 1, 0, 0, 1),
    }
    m = got.state["matches"].collect()
    assert {(r.tree_id, r.person_id, r.url, r.origin) for r in m} == {(1, "I1", "https://a.de/1?utm_source=x", "f2"), (1, "I1", "https://b.de/9", "f1"), (2, "I1", "https://a.de/1", "f1")}
    assert got.summary.first().asDict() == {"ingested": 5, "skipped": 0, "failed": 1, "stored": 4}
    assert rows_of(got.state["memory"], *D.PERSON, "finder_id", "signature", "recorded_at") == {(1, "I2", "f1", "s2", 30)}
    assert rows_of(got.state["coverage"], *D.PERSON, "finder_id", "job_id") == {(1, "I1", "f1", "j1"), (1, "I1", "f2", "j2"), (2, "I1", "f1", "j3"), (1, "I2", "f1", "j4"), (1, "I9", "f2", "j7")}
    more = D.drain_tables(responses(spark, SECOND), known(spark), got.state)
    assert rows_of(more.state["memory"], *D.PERSON, "finder_id", "recorded_at") == {(1, "I2", "f4", 60)}
    assert rows_of(more.jobs, "job_id", "action") == {("k1", "ingest"), ("k2", "ingest"), ("k3", "ingest"), ("k4", "ingest"), ("j1", "done")}
    portals = {(r.person_id, r.finder_id): [(p.status, p.notice_count) for p in r.portals] for r in more.state["coverage"].where("tree_id = 1").collect()}
    assert portals["I1", "f1"] == [("failed", 0)] and portals["I1", "f2"] == [("ok", 1)] and portals["I2", "f2"] == [("ok", 1)]
    assert more.state["jobs"].count() == 6 + 4 and more.state["matches"].count() == 4


def test_release_limit_and_nothing(spark):
    got = D.drain_tables(responses(spark, FIRST), known(spark), only_tree=2)
    assert rows_of(got.jobs.where("action = 'ingest'"), "job_id") == {("j3",)} and got.summary.first().skipped == 4
    assert rows_of(got.state["jobs"], "job_id") == {("j3",), ("j5",)}, "released jobs are not done"
    got = D.drain_tables(responses(spark, FIRST), known(spark), limit=2)
    assert rows_of(got.jobs, "job_id", "action") >= {("j1", "ingest"), ("j2", "ingest"), ("j3", "waiting")}
    got = D.drain_tables(responses(spark, []), known(spark))
    assert set(got.summary.first()) == {0} and all(df.count() == 0 for df in got.state.values())
    null = [line(None, 1), line("n", 2, person=None) | {"requested_person_ids": None}, line("m", None, None, None) | {"body": None}]
    got = D.drain_tables(responses(spark, null), known(spark))
    assert rows_of(got.jobs, "job_id", "action") == {(None, "waiting"), ("n", "failed"), ("m", "failed")}


def test_stream_keeps_tables(spark, tmp_path, monkeypatch):
    """Three starts: a batch, a batch whose commit is lost half way, and its replay; then a batch that was committed unheard."""
    landing, out, held, trees = (str(tmp_path / x) for x in ("in", "out", "people", "trees"))
    known(spark).write.parquet(held)
    spark.createDataFrame([(1,), (2,)], "tree_id int").write.parquet(trees)
    land = lambda rows: responses(spark, rows).coalesce(1).write.mode("append").json(landing)
    run = lambda: D.drain(spark, landing, out, str(tmp_path / "cp"), held, trees=trees, buckets=16).awaitTermination(240)
    land(FIRST)
    run()
    store = KeyedStore(spark, f"{out}/state", D.TABLES)
    before = store.pointer()
    assert store.buckets == 16 and before.version == 1 and before.marks == {"": 0}
    assert rows_of(D.kept(spark, out, "matches"), "tree_id", "origin", "url") == {(1, "f2", "https://a.de/1?utm_source=x"), (1, "f1", "https://b.de/9"), (2, "f1", "https://a.de/1")}
    land(SECOND)
    commit = KeyedStore.commit

    def lost(self, changes, source="", mark=0):
        self_rename, self._fs = self._fs, Broken(self._fs)
        try:
            return commit(self, changes, source, mark)
        finally:
            self._fs = self_rename

    monkeypatch.setattr(KeyedStore, "commit", lost)
    with pytest.raises(Exception, match="lost"):
        run()
    assert store.pointer() == before and D.kept(spark, out, "memory").count() == 1
    monkeypatch.setattr(KeyedStore, "commit", commit)
    run()
    after = store.pointer()
    assert after.version == 2 and after.marks == {"": 1}
    assert rows_of(D.kept(spark, out, "memory"), *D.PERSON, "finder_id", "recorded_at") == {(1, "I2", "f4", 60)}
    assert D.kept(spark, out, "matches").count() == 4 and spark.read.parquet(f"{out}/summary").count() == 2
    # Only the buckets of the people and jobs of the second batch are of its version.
    one = lambda t, tree, person: int(spark.createDataFrame([(tree, person)], "tree_id int, person_id string").select(store.bucket(t)).first()[0])
    touched = {one("matches", 1, "I1"), one("matches", 1, "I2")}
    assert {b for b, v in after.tables["coverage"].items() if v == 2} == touched
    assert all(v == 1 for b, v in after.tables["matches"].items() if b not in touched) and one("matches", 2, "I1") in after.tables["matches"]
    # A batch that is committed runs once more: nothing changes.
    D.write_batch(out, held, trees=trees)(responses(spark, FIRST), 1)
    assert store.pointer() == after
    # Vacuum keeps what the last version reads.
    want = {t: sorted(map(str, D.kept(spark, out, t).collect())) for t in D.TABLES}
    store.vacuum(keep=1)
    assert {t: sorted(map(str, D.kept(spark, out, t).collect())) for t in D.TABLES} == want and store.pointer() == after


class Broken:
    """A file system whose renames fail: the process is lost before the pointer is there."""

    def __init__(self, fs):
        self.fs = fs

    def __getattr__(self, name):
        if name == "rename":
            raise RuntimeError("lost")
        return getattr(self.fs, name)


def test_keyed_store(spark, tmp_path):
    tables = {"t": Table("k int, v string", ("k",))}
    store = KeyedStore(spark, str(tmp_path / "s"), tables, 4)
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert store.read("t").count() == 0 and store.pointer().version == 0
    all_ = df([(k, "a") for k in range(20)])
    store.commit({"t": (all_, list(range(4)))}, "x", 3)
    old = store.pointer()
    b = store.touched("t", df([(7, "")]))
    assert len(b) == 1
    rest = store.read("t", b)
    assert 0 < rest.count() < 20
    store.commit({"t": (rest.withColumn("v", F.lit("b")), b)})
    assert store.read("t").where("v = 'b'").count() == rest.count() and store.read("t").count() == 20
    assert store.read("t", at=old).where("v = 'b'").count() == 0, "a reader keeps the version it began with"
    with pytest.raises(ValueError, match="does not replace"):
        store.commit({"t": (all_, b)})
    store.commit({"t": (rest.limit(0), b)})
    assert store.read("t").count() == 20 - rest.count() and store.pointer().marks == {"x": 3, "": 0}
    assert store.pointer().version == 3 and KeyedStore(spark, str(tmp_path / "s"), tables, 99).buckets == 4
