"""The interval join, pages by key, state with timers, and drains of several finders, against brute force and SQL."""

import json
import random
from collections import Counter

import pytest
from compare import same_rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo
from test_drain import known, line, notice, responses

from kinfold.functions import registry
from kinfold.functions import text as T
from kinfold.operators import counting, intervals, scoring, stores
from kinfold.plans import state as plans
from kinfold.sources import bucketed, documents, folders
from kinfold.sources.forms import Forms
from kinfold.sources.pages import Pages, write_pages
from kinfold.streaming import drain as D
from kinfold.streaming import fan_out, searches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(spark, plans.QUERIES[name], plans.ORACLE_SQL[name], SF)


# ---- intervals ----


def ranges(rng, n, keys, wide):
    out = []
    for i in range(n):
        lo = rng.choice([None, *range(-500, 500)])
        hi = None if rng.random() < 0.05 else (lo or 0) + rng.choice([0, 1, 3, 17, wide, -2])
        out.append((i % (n - 5), lo, hi, rng.choice(keys)))
    return out


@pytest.mark.parametrize(("bin_rows", "keys"), [(1 << 14, ["a", "b", None]), (7, ["a"])])
def test_overlaps(spark, bin_rows, keys):
    """Open ends, empty ranges, repeated rows, null keys, and hot bins of both sides that are split; columns named like the join's own."""
    rng = random.Random(3)
    a, b = ranges(rng, 120, keys, 900), ranges(rng, 150, keys, 64)
    schema = "i int, lo int, hi int, level string"
    got = intervals.overlap_join(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema), on=["level"], bin_rows=bin_rows)
    inf = float("inf")
    whole = lambda r: (-inf if r[1] is None else r[1], inf if r[2] is None else r[2])
    want = Counter()
    for x in a:
        for y in b:
            (p, q), (r, s) = whole(x), whole(y)
            if x[3] is not None and x[3] == y[3] and p <= q and r <= s and p <= s and r <= q:
                want[x, y] += 1
    assert Counter((tuple(r.l), tuple(r.r)) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_of_few_move_once(spark, monkeypatch):
    """Small groups meet without bins, so their rows are not multiplied; crowded ones beside them keep theirs."""
    rng = random.Random(5)
    a, b = ranges(rng, 90, ["a", "b", "c", None], 900), ranges(rng, 90, ["a", "b", "d"], 64)
    df = lambda rows: spark.createDataFrame([*rows, (0, 0, 5, "e")], "i int, lo int, hi int, l string")
    few = intervals.overlap_join(df(a), df(b), on=["l"])
    assert "Generate" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(intervals, "WHOLE_ROWS", 3)
    some = intervals.overlap_join(df(a), df(b), on=["l"])
    assert "Generate" in some._jdf.queryExecution().executedPlan().toString()
    rows = lambda got: Counter((tuple(r.l), tuple(r.r)) for r in got.collect())
    assert rows(few) == rows(some) and ((0, 0, 5, "e"),) * 2 in rows(few) and len(rows(few)) > 50


def test_overlaps_of_nothing(spark):
    empty = spark.createDataFrame([], "lo long, hi long")
    one = spark.createDataFrame([(None, None)], "lo long, hi long")
    assert intervals.overlap_join(empty, one).collect() == [] and intervals.overlap_join(one, one).count() == 1
    big = spark.createDataFrame([(-(1 << 60), 1 << 60), (1 << 60, 1 << 60)], "lo long, hi long")
    assert intervals.overlap_join(big, big).count() == 4


# ---- pages ----


def test_pages(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(30), i) for i in range(1003)]
    df = spark.createDataFrame(rows, "score int, i int").repartition(5)
    path = str(tmp_path / "p")
    write_pages(df, [F.desc("score"), F.asc("i")], path, parts=7)
    pages = Pages.open(spark, path)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert pages.total() == 1003 and len(pages.counts) > 3
    for number, size in ((1, 50), (2, 50), (20, 50), (21, 50), (99, 50), (0, 50), (3, 400), (1, 2000), (5, 1)):
        at = (min(max(1, number), -(-1003 // size)) - 1) * size
        assert [tuple(r) for r in pages.page(number, size).collect()] == want[at : at + size]
    # A page deep down opens as few parts as an early one, and one more at most.
    opened = lambda n: len(pages.page(n).inputFiles())
    assert all(opened(n) <= 2 for n in range(1, 22)) and opened(2) <= opened(20) + 1
    write_pages(df.limit(0), [F.asc("i")], str(tmp_path / "q"), parts=7)
    assert Pages.open(spark, str(tmp_path / "q")).page(1).collect() == []


def test_counts_and_scans_that_stop(spark, tmp_path):
    """A limit of a few reads a few parts of many; below the limit all are read and counted; no limit, no rows."""
    path = str(tmp_path / "p")
    write_pages(spark.range(4000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k"), "id"), [F.asc("k")], path, parts=40)
    pages = Pages.open(spark, path)
    even = lambda rows: rows.where("id % 2 = 0")
    got, read = counting.first_that(pages, even, [F.asc("k")], 30)
    assert [r.id for r in got.collect()] == list(range(0, 60, 2)) and read < 400
    got, read = counting.first_that(pages, lambda rows: rows.where("id >= 3990"), [F.asc("k")], 30)
    assert [r.id for r in got.collect()] == list(range(3990, 4000)) and read == 4000
    got, read = counting.first_that(pages, even, [F.asc("k")], 0)
    assert got.collect() == [] and read == 0
    assert [counting.count_up_to(spark.range(50), n) for n in (0, 7, 50, 99)] == [0, 7, 50, 50]
    assert [tuple(counting.preview(spark.range(50), n).first()) for n in (7, 50, 99)] == [(7, True), (50, False), (50, False)]


def test_bucketed_joins_move_nothing(spark):
    """Joins and counts by person of bucketed tables have no exchange; of other numbers of buckets, or none, they are right all the same."""
    rows = [(i % 40 if i % 9 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "p long, v long")
    a, b, c = (bucketed.write_bucketed(df, f"bucketed_{n}_{k}", ["p"], n) for k, n in enumerate((4, 4, 3)))
    df.write.mode("overwrite").option("path", folders.scratch(spark, "flat")).saveAsTable("bucketed_flat")
    assert bucketed.co_located(spark, ["bucketed_4_0", "bucketed_4_1"]) and not bucketed.co_located(spark, ["bucketed_4_0", "bucketed_3_2"]) and not bucketed.co_located(spark, ["bucketed_4_0", "bucketed_flat"])
    counted = lambda x, y: x.join(y.groupBy("p").agg(F.count("*").alias("n")).hint("merge"), "p")
    plan = counted(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
    want = Counter((p, v, sum(q == p for q, _ in rows)) for p, v in rows if p is not None)
    for other in (b, c, spark.table("bucketed_flat")):
        assert Counter(tuple(r) for r in counted(a, other).collect()) == want
    deal = stores.select_candidates(a, b.where("v > 150"), b.withColumnRenamed("v", "born"), "p", "born", 300, 100)
    assert "hashpartitioning" not in deal.hint("merge")._jdf.queryExecution().executedPlan().toString()


# ---- forms and encoders ----


def test_forms_are_worked_out_once(spark, tmp_path):
    forms = Forms(spark, str(tmp_path / "f"), {"code": T.phonetic, "normal": T.normalize})
    rows = [("Müller",), ("Mueller",), ("Müller",), (None,), ("",)]
    df = spark.createDataFrame(rows, "name string").repartition(3)
    assert forms.read().count() == 0 and forms.extend(df, "name") == 3
    more = df.union(spark.createDataFrame([("Weiß",)], "name string"))
    assert forms.extend(more, "name") == 1 and forms.extend(more, "name") == 0, "only what is new goes through the expressions"
    got = forms.join(more, "name").collect()
    assert Counter((r.name, r.code, r.normal) for r in got) == Counter({("Müller", "657", "mueller"): 2, ("Mueller", "657", "mueller"): 1, (None, None, None): 1, ("", "", ""): 1, ("Weiß", "38", "weiss"): 1})


def test_encoders_by_name(spark):
    """The registered SQL is the column functions' code, its plan has no call left, and another encoder can take its place."""
    rows = spark.createDataFrame([(x,) for x in ("Müller-Lüdenscheidt", " Dr. Käthe  Weiß", "geb. Schmidt", "Dr.Phil", "Çelik", None, "", "Xaver", "Philipp")], "x string")
    registry.register(spark, "cologne")
    got = rows.selectExpr("x", "kinfold_strip(x) AS s", "kinfold_encode(x) AS c").withColumns({"s2": T.strip(F.col("x")), "c2": T.phonetic(F.col("x"))})
    assert all((r.s, r.c) == (r.s2, r.c2) for r in got.collect())
    assert "kinfold_encode" not in rows.selectExpr("kinfold_encode(x) AS c")._jdf.queryExecution().optimizedPlan().toString()
    registry.register(spark, "skeleton")
    people = spark.createDataFrame([((["Eva"], "Maier", None, None),)], "name struct<given_names:array<string>,surname:string,birth_surname:string,married_surnames:array<string>>")
    assert scoring.with_keys(people, "name", "c", registry.encoder("skeleton")).first().c_code == "mr" and scoring.with_keys(people, "name", "c").first().c_code == "67"
    with pytest.raises(ValueError, match="no encoder"):
        registry.register(spark, "none")


# ---- documents ----


def test_documents(spark, tmp_path):
    """Sound, corrupt, misfiled, foreign and too large files; a filter on people opens their folders alone; a look-up raises."""
    root = tmp_path / "d"
    rows = [(f"P{i}", f"k {i}/{j}", json.dumps({"personId": f"P{i}", "n": j})) for i in range(12) for j in range(3)]
    documents.write(spark.createDataFrame(rows, "person_id string, row_key string, raw string").repartition(3), str(root))
    documents.write(spark.createDataFrame(rows[:2], "person_id string, row_key string, raw string"), str(root))
    folder = root / documents.folder_of("P1")
    (folder / "bad.json").write_text("{")
    (folder / "other.json").write_text('{"personId":"P2"}')
    (folder / "bytes.json").write_bytes(b"\xff\xfe")
    (folder / "note.txt").write_text("x")
    (folder / "big.json").write_text('{"personId":"P1","x":"' + "y" * 5000 + '"}')
    (root / "empty").mkdir()
    got = documents.read(spark, str(root), cap=4000, folders_per_task=5).collect()
    sound = {(r.person_id, r.row_key, r.raw) for r in got if r.error is None}
    assert sound == set(rows) and len(got) == len(rows) + 4
    assert {r.row_key: r.error for r in got if r.error} == {"bad": "not_json", "other": "misfiled", "bytes": "not_text", "big": "too_large"}
    one = documents.read(spark, str(root)).where(F.col("person_id").isin("P3", "P4") & F.col("row_key").contains("/"))
    assert {r.row_key for r in one.collect()} == {f"k {i}/{j}" for i in (3, 4) for j in range(3)}
    reader = documents.Reader({"path": str(root)})
    list(reader.pushFilters([EqualTo(("person_id",), "P3"), EqualTo(("row_key",), "x")]))
    assert [p.names for p in reader.partitions()] == [[documents.folder_of("P3")]]
    assert sum(len(p.names) for p in documents.Reader({"path": str(root), "folders_per_task": "5"}).partitions()) == 13
    assert documents.read_one(spark, str(root), "P5", "k 5/1") == rows[16][2] and documents.read_one(spark, str(root), "P5", "none") is None
    for key in ("bad", "other", "bytes"):
        with pytest.raises(documents.CorruptDocument, match=key):
            documents.read_one(spark, str(root), "P1", key)
    assert documents.read(spark, str(tmp_path / "none")).collect() == []


# ---- state ----


def events(rng, n):
    """By time, with equal ones; people of two trees."""
    out, at = [], 10_000
    for i in range(n):
        at += rng.choice([0, 60, 3_000, 40_000])
        out.append((rng.randrange(2), rng.choice(["p", "q", "r"]), rng.choice(["f", "g"]), rng.choice(["miss", "miss", "ask", "ask", "ask", "find"]), rng.choice(["s", "t"]), at, i))
    return out


def brute_memory(rows, ttl):
    held, out = {}, Counter()
    for tree, person, finder, kind, sig, at, seq in sorted(rows, key=lambda r: (r[5], r[6])):
        if kind == "miss":
            held[tree, person, finder] = sig, at
        elif kind == "find":
            held = {k: v for k, v in held.items() if k[:2] != (tree, person)}
        else:
            s, t = held.get((tree, person, finder), (None, None))
            out[tree, person, finder, at, seq, "suppressed" if s == sig and at - t < ttl else "searched"] += 1
    return out


def test_memory_at_rest_and_as_stream(spark, tmp_path):
    """Three starts of the stream: suppression, clearing by another finder's find, and expiry, as at rest."""
    ttl, rows = 200_000, events(random.Random(5), 240)
    want = brute_memory(rows, ttl)
    assert {k[-1] for k in want} == {"suppressed", "searched"}
    assert Counter(tuple(r) for r in searches.verdicts(spark.createDataFrame(rows, searches.EVENTS), ttl).collect()) == want
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], searches.EVENTS).coalesce(1).write.mode("append").json(landing)
        stream = spark.readStream.schema(searches.EVENTS).json(landing)
        query = searches.remember(stream, ttl).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    got = [tuple(r) for r in spark.read.schema(searches.OUTCOMES).parquet(out).collect()]
    assert Counter(r for r in got if r[-1] != "expired") == want
    # Each memory that ran out did so once, at the end of its time, and none that a find or a later miss had ended before.
    expired = {r[:4] for r in got if r[-1] == "expired"}
    assert expired and len(expired) == sum(r[-1] == "expired" for r in got)
    misses = {(t, p, f, at + ttl) for t, p, f, kind, _, at, _ in rows if kind == "miss"}
    ended = lambda t, p, f, end: any((t, p) == r[:2] and end - ttl < r[5] < end and (r[3] == "find" or (r[3] == "miss" and r[2] == f)) for r in rows)
    assert expired <= misses and not any(ended(*x) for x in expired)
    last = max(r[5] for r in rows)
    assert {m for m in misses if m[3] < last - 3_700 and not ended(*m) and not any(r[:3] == m[:3] and r[5] == m[3] - ttl and r[3] in ("find", "miss") and r[6] > next(x[6] for x in rows if x[:3] == m[:3] and x[3] == "miss" and x[5] == m[3] - ttl) for r in rows)} <= expired | {m for m in misses if any(r[:2] == m[:2] and r[3] == "find" and r[5] == m[3] - ttl for r in rows)}


def test_claims_as_stream(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("j", "record", 50, 1), ("j", "claim", 100, 2), ("j", "claim", 200, 3), ("x", "claim", 200, 4)],
        [("k", "record", 5_000, 5), ("j", "claim", 5_000, 6)],
        [("j", "release", 5_100, 7), ("j", "release", 5_100, 8), ("k", "remove", 5_200, 9), ("k", "claim", 5_300, 10)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, searches.CLAIMS).coalesce(1).write.mode("append").json(landing)
        stream = spark.readStream.schema(searches.CLAIMS).json(landing)
        query = searches.claims(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    got = spark.read.schema(searches.CLAIMED).parquet(out).collect()
    assert {r.seq: r.outcome for r in got if r.seq} == {1: "recorded", 2: "claimed", 3: "lost", 4: "lost", 5: "recorded", 6: "claimed", 7: "released", 8: "unchanged", 9: "removed", 10: "lost"}
    assert [(r.job_id, r.at) for r in got if r.outcome == "stale"] in ([], [("j", 3_700)])


# ---- finders ----


def test_fan_out(spark, tmp_path, monkeypatch):
    """One finder's stream fails each time, another's once: the third is not stopped, the sum is of those that did, and a later run goes on."""
    held = str(tmp_path / "people")
    known(spark).write.parquet(held)
    land = {f: str(tmp_path / f) for f in ("f1", "f2", "f3")}
    for k, f in enumerate(land):
        responses(spark, [line(f"j{k}", 10 + k, f, notices=[notice(f"https://a.de/{k}")])]).coalesce(1).write.json(land[f])
    tries, real = Counter(), D.write_batch

    def broken(out, people, source="", *more):
        write = real(out, people, source, *more)

        def run(batch, batch_id):
            tries[source] += 1
            if source == "f2" or (source == "f3" and tries[source] == 1):
                raise RuntimeError("gone")
            write(batch, batch_id)

        return run

    monkeypatch.setattr(D, "write_batch", broken)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    got = fan_out.drain_all(spark, land, out, cp, held, restarts=1, pause=0, buckets=4)
    assert got.exit_code == 1 and set(got.failures) == {"f2"} and got.restarts == {"f2": 1, "f3": 1}
    assert got.sums == {"ingested": 2, "skipped": 0, "failed": 0, "stored": 2}
    monkeypatch.setattr(D, "write_batch", real)
    got = fan_out.drain_all(spark, land, out, cp, held, restarts=0, pause=0)
    assert got.exit_code == 0 and got.sums == {"ingested": 1, "skipped": 0, "failed": 0, "stored": 1}
    assert {r.origin for r in D.kept(spark, out, "matches").collect()} == {"f1", "f2", "f3"}
