"""The drain as a stream: response files that land in a folder are validated, routed, scored and kept, batch by batch.

What is kept (matches, coverage, negative memory, jobs that are done) are keyed tables: a batch rewrites only the
buckets of the people and jobs that it names, and its pointer is written last. A batch that runs again, whole or from the
middle, leaves the same content; a job that is delivered again is not taken again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, ledger, stores
from ..sources.folders import drop_staged, staged
from ..sources.keyed import KeyedStore, Table
from ..sources.responses import details, validate

RESPONSES = "job_id string, tree_id int, requested_person_ids array<string>, signature string, finder_id string, received_at long, body string"
PERSON = ("tree_id", "person_id")
#: A batch's jobs take their turns by arrival, then id.
TURN = ("received_at", "job_id")
_PORTALS = "array<struct<seq:int,portal:string,status:string,notice_count:long,message:string>>"
TABLES = {
    "matches": Table("tree_id int, person_id string, row_key string, url string, status string, reason string, match string, write_back string, origin string", PERSON),
    "coverage": Table(f"tree_id int, person_id string, finder_id string, received_at long, job_id string, portals {_PORTALS}", PERSON),
    "memory": Table("tree_id int, person_id string, finder_id string, signature string, recorded_at long", PERSON),
    "jobs": Table("job_id string, tree_id int, finder_id string, received_at long, action string, reason string, notices_read long, candidates_found long, matches_stored long, warnings long", ("job_id",)),
}
DONE = ("ingest", "failed", "unknown_tree")


@dataclass(frozen=True)
class Drained:
    """state: the keyed tables after the batch, of the people and jobs it names and of others as far as they were given.

    jobs: every job of the batch and its action (ingest, failed, unknown_tree, release, retry, done), with counters.
    notices: of the jobs that were taken in. warnings: job_id, key, kind, portal, n. summary: one row.
    """

    state: dict[str, DataFrame]
    jobs: DataFrame
    notices: DataFrame
    warnings: DataFrame
    summary: DataFrame


def _empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table].schema)


def merge_searches(coverage: DataFrame, known: DataFrame) -> DataFrame:
    """known (of TABLES) with what the batch's jobs say: of a person and a finder the last job's portals, whole."""
    portal = F.struct(F.col("seq").cast("int").alias("seq"), "portal", "status", F.col("notice_count").cast("long").alias("notice_count"), "message")
    new = coverage.groupBy(*PERSON, "finder_id", *TURN).agg(F.array_sort(F.collect_list(portal)).cast(_PORTALS).alias("portals"))
    both = known.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    return stores.last_wins(both, [*PERSON, "finder_id"], ["__new", *TURN]).drop("__new")


def remember(coverage: DataFrame, people: DataFrame, known: DataFrame) -> DataFrame:
    """known (of TABLES) after the batch's searches, turn by turn: one in vain of someone held is remembered by its finder, a find forgets all finders' of the person."""
    outcome = stores.search_outcome(coverage, [*PERSON, "finder_id", *TURN])
    found = outcome.where("outcome = 'found'").groupBy(*PERSON).agg(F.max(F.struct(*TURN)).alias("__found"))
    vain = outcome.where("outcome = 'no_notices'").drop("outcome").join(people.select(*PERSON, "signature"), list(PERSON))
    new = vain.select(*PERSON, "finder_id", "signature", F.col("received_at").alias("recorded_at"), F.struct(*TURN).alias("__turn"))
    old = known.withColumn("__turn", F.lit(None).cast(new.schema["__turn"].dataType))
    left = old.unionByName(new).join(found, list(PERSON), "left").where(F.col("__found").isNull() | F.coalesce(F.col("__turn") > F.col("__found"), F.lit(False)))
    last = stores.last_wins(left.drop("__found").withColumn("__new", F.col("__turn").isNotNull()), [*PERSON, "finder_id"], ["__new", "__turn"])
    return last.drop("__new", "__turn")


def drain_tables(
    responses: DataFrame, people: DataFrame, state: dict[str, DataFrame] | None = None, trees: DataFrame | None = None, only_tree: int | None = None, limit: int | None = None,
    stage: Callable[[DataFrame, str], DataFrame] = staged,
) -> Drained:
    """What a batch of responses (RESPONSES) does to the keyed tables.

    people: those who may be asked for, by tree (as ingest.ingest() has them, with tree_id and signature); without a row a
    person is not held. trees: the ones there are (tree_id); those of people if not given. Of a job's responses the first to
    arrive that is an answer counts; a job that state has as done is not taken again. A failed job, one of an unknown
    tree and one of another tree than only_tree adds nothing but its action. Of several notices of a person's URL the last job's
    counts, then its last; its finder is the match's origin. limit: of jobs taken, by id. Null ids of people match nobody.
    stage keeps what several outputs read (parsed responses, jobs taken, their notices and coverage), each worked out once.
    """
    spark = responses.sparkSession
    state = {t: (state or {}).get(t, _empty(spark, t)) for t in TABLES}
    trees = people.select("tree_id").distinct() if trees is None else trees
    once = responses.dropDuplicates().withColumn("response", F.xxhash64("body"))
    v = validate(once, carry=("tree_id", "finder_id", "received_at", "response"), stage=lambda rows: stage(rows, "parsed"))
    answers = v.jobs.withColumn("__first", F.struct(F.col("route") == "retry", "received_at", "response"))
    first = answers.groupBy("job_id").agg(F.min_by(F.struct("tree_id", "finder_id", "received_at", "response", "route", "reason", "requested_person_ids"), "__first").alias("x")).select("job_id", "x.*")
    done = state["jobs"].select("job_id").withColumn("__done", F.lit(True))
    first = first.join(done, "job_id", "left")
    queued = first.where("__done is null").withColumn("claimed_at", F.lit(None).cast("long"))
    taken = ledger.take(queued, queued, 0, limit, trees, only_tree).select("job_id", "action")
    rest = F.when(F.col("__done"), "done").when(F.col("route") == "retry", "retry").otherwise("waiting")
    jobs = stage(first.join(taken, "job_id", "left").withColumn("action", F.coalesce("action", rest)), "taken")

    good = jobs.where("action = 'ingest'").select("job_id", "received_at", "response")
    found, coverage = (stage(x.join(good, ["job_id", "received_at", "response"], "left_semi").drop("response"), tag) for x, tag in ((v.found, "notices"), (v.coverage, "coverage")))
    # Of a person's notices of one URL the last alone is read in full.
    last = stores.last_wins(found, [*PERSON, "row_key"], [*TURN, "seq"]).select(*found.columns)
    got = ingest.ingest(details(last), coverage, people, state["matches"], origin=F.col("finder_id"), key=PERSON, order=(*TURN, "seq"))

    # By job: notices read, people of those asked for who are held, matches stored, warnings.
    asked = jobs.where("action = 'ingest'").select("job_id", "tree_id", F.explode("requested_person_ids").alias("person_id")).distinct()
    held = people.select(*PERSON).distinct()
    candidates = asked.join(held, list(PERSON), "left_semi").groupBy("job_id").agg(F.count("*").alias("candidates_found"))
    read = found.groupBy("job_id").agg(F.count("*").alias("notices_read"))
    kept = found.select("job_id", *PERSON, "row_key").distinct().join(got.stored_keys, [*PERSON, "row_key"], "left_semi").groupBy("job_id").agg(F.count("*").alias("matches_stored"))
    unheld = found.join(held, list(PERSON), "left_anti").groupBy("job_id", *PERSON).agg(F.count("*").alias("n")).select("job_id", *PERSON, F.lit("no_candidate").alias("kind"), F.lit(None).cast("string").alias("portal"), "n")
    silent = coverage.where("status = 'failed'").join(held, list(PERSON), "left_semi").select("job_id", *PERSON, F.lit("portal_failed").alias("kind"), "portal", F.lit(1).cast("long").alias("n"))
    warnings = unheld.union(silent)
    numbers = ("notices_read", "candidates_found", "matches_stored", "warnings")
    for counts in (read, candidates, kept, warnings.groupBy("job_id").agg(F.count("*").alias("warnings"))):
        jobs = jobs.join(counts, "job_id", "left")
    jobs = jobs.select("job_id", "tree_id", "finder_id", "received_at", "action", "reason", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers))
    action = F.col("action")
    summary = jobs.agg(
        F.count_if(action == "ingest").alias("ingested"), F.count_if(action == "release").alias("skipped"), F.count_if(action.isin("failed", "unknown_tree")).alias("failed"),
        F.coalesce(F.sum("matches_stored"), F.lit(0)).alias("stored"),
    )
    after = {
        "matches": got.matches,
        "coverage": merge_searches(coverage, state["coverage"]),
        "memory": remember(coverage, people, state["memory"]),
        "jobs": state["jobs"].unionByName(jobs.where(action.isin(*DONE))),
    }
    return Drained(after, jobs, details(found), warnings, summary)


def write_batch(out: str, people: str, source: str = "", trees: str | None = None, only_tree: int | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Takes a batch in: its jobs, notices, warnings and summary under <out>/<table>/batch=<source><id>, the keyed tables under <out>/state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = KeyedStore(spark, f"{out}/state", TABLES, buckets)
        now = store.pointer()
        if now.marks.get(source, -1) >= batch_id:
            return  # committed before, only the stream did not hear of it
        held: list[DataFrame] = []
        stage = lambda rows, tag: held.append(staged(rows, tag)) or held[-1]
        batch = stage(batch, "batch")
        try:
            asked = batch.select("job_id", "tree_id", F.explode_outer("requested_person_ids").alias("person_id"))
            touched = {t: store.touched(t, asked) for t in TABLES}
            known = spark.read.parquet(people)
            # A batch's people are few beside a tree's: only they are keyed for scoring.
            known = known.join(asked.select(*PERSON).distinct(), list(PERSON), "left_semi")
            there = spark.read.parquet(trees) if trees else spark.read.parquet(people).select("tree_id").distinct()
            got = drain_tables(batch, known, {t: store.read(t, touched[t], now) for t in TABLES}, there, only_tree, stage=stage)
            for name, df in (("jobs", got.jobs), ("notices", got.notices), ("warnings", got.warnings)):
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={source}{batch_id}")
            got.summary.write.mode("overwrite").parquet(f"{out}/summary/batch={source}{batch_id}")
            store.commit({t: (df, touched[t]) for t, df in got.state.items()}, source, batch_id)
        finally:
            for df in held:
                drop_staged(df)

    return write


def drain(
    spark: SparkSession, landing: str, out: str, checkpoint: str, people: str, files_per_batch: int = 1_000, source: str = "", trees: str | None = None, only_tree: int | None = None, buckets: int = 64
) -> StreamingQuery:
    """Start a drain of JSON lines (RESPONSES) that land in a folder; it ends when all files that are there have been taken.

    people: a Parquet folder of those who may be asked for. source names the stream where several write to one out, one at a time.
    """
    rows = spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).json(landing)
    writer = write_batch(out, people, source, trees, only_tree, buckets)
    return rows.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, out: str, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """A keyed table as the last batch left it."""
    return KeyedStore(spark, f"{out}/state", TABLES).read(table, None if buckets is None else list(buckets))
