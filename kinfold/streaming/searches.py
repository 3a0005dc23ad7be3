"""What is remembered of searches, and who has claimed a job, as state with timers.

The state of a person (all finders') or of a job is kept by its key in the state store; what runs out does so by a timer of
event time, so that state does not grow with what was once asked. verdicts() says the same of events at rest.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.review import STALE_AFTER

TTL = 2_592_000
#: kind: miss (a search in vain), find, ask (may this finder search?). at: seconds; seq decides among equal ones.
EVENTS = "tree_id int, person_id string, finder_id string, kind string, signature string, at long, seq long"
OUTCOMES = "tree_id int, person_id string, finder_id string, at long, seq long, outcome string"
#: kind: record, claim, release or remove.
CLAIMS = "job_id string, kind string, at long, seq long"
CLAIMED = "job_id string, at long, seq long, outcome string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdicts(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """OUTCOMES of every ask: suppressed if the finder's last search was in vain, with the same signature, less than ttl seconds ago and nobody has found anything since; else searched."""
    key, order = ["tree_id", "person_id"], ["at", "seq"]
    before = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.struct(*order, "signature")
    miss = F.last(F.when(F.col("kind") == "miss", turn), ignorenulls=True).over(before(*key, "finder_id"))
    find = F.last(F.when(F.col("kind") == "find", F.struct(*order)), ignorenulls=True).over(before(*key))
    rows = events.withColumns({"__miss": miss, "__find": find}).where("kind = 'ask'")
    m, f = F.col("__miss"), F.col("__find")
    held = m.isNotNull() & (f.isNull() | (F.struct(m["at"], m["seq"]) > f)) & m["signature"].eqNullSafe(F.col("signature")) & (F.col("at") - m["at"] < ttl)
    return rows.select(*key, "finder_id", *order, F.when(F.coalesce(held, F.lit(False)), "suppressed").otherwise("searched").alias("outcome"))


class Memory(StatefulProcessor):
    """By person: the last search in vain of each finder."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.misses = handle.getMapState("misses", "finder_id string", "signature string, at long")

    def _now(self) -> dict[str, tuple]:
        return {k[0]: (v[0], v[1]) for k, v in self.misses.iterator()} if self.misses.exists() else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._now()
        was = dict(held)
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):  # of one person in one batch
            finder = r["finder_id"] or ""
            for gone in [k for k, (_, at) in held.items() if at + self.ttl <= r["at"]]:  # its timer would come later
                yield self._expired(key, gone, held.pop(gone)[1])
            if r["kind"] == "miss":
                held[finder] = r["signature"], r["at"]
            elif r["kind"] == "find":
                held.clear()
            elif r["kind"] == "ask":
                signature, at = held.get(finder, (None, None))
                hit = at is not None and signature == r["signature"] and r["at"] - at < self.ttl
                yield Row(tree_id=key[0], person_id=key[1], finder_id=r["finder_id"], at=r["at"], seq=r["seq"], outcome="suppressed" if hit else "searched")
        for finder in was.keys() - held.keys():
            self.misses.removeKey((finder,))
        for finder, (signature, at) in held.items():
            if was.get(finder) != (signature, at):
                self.misses.updateValue((finder,), (signature, at))
                self.handle.registerTimer((at + self.ttl) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for finder, (_, at) in self._now().items():
            if (at + self.ttl) * 1000 <= now:  # not one that was renewed since
                self.misses.removeKey((finder,))
                yield self._expired(key, finder, at)

    def _expired(self, key, finder: str, at: int) -> Row:
        return Row(tree_id=key[0], person_id=key[1], finder_id=finder, at=at + self.ttl, seq=None, outcome="expired")

    def close(self) -> None:
        pass


class Claims(StatefulProcessor):
    """By job: since when it is claimed (none while it is queued). A claim that is not ended in time goes back by a timer."""

    def __init__(self, stale_after: int):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "claimed_at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, claimed = self.job.exists(), None
        if held:
            claimed = self.job.get()[0]
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            outcome, at = "unchanged", r["at"]
            if claimed is not None and at - claimed >= self.stale_after:
                claimed = None
            if r["kind"] == "record":
                held, claimed, outcome = True, None, "recorded"
            elif r["kind"] == "claim":
                outcome = "claimed" if held and claimed is None else "lost"
                claimed = at if outcome == "claimed" else claimed
            elif r["kind"] == "release" and held and claimed is not None:
                claimed, outcome = None, "released"
            elif r["kind"] == "remove" and held:
                held, claimed, outcome = False, None, "removed"
            yield Row(job_id=key[0], at=at, seq=r["seq"], outcome=outcome)
        if not held:
            self.job.clear()
        else:
            self.job.update((claimed,))
            if claimed is not None:
                self.handle.registerTimer((claimed + self.stale_after) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        claimed = self.job.get()[0] if self.job.exists() else None
        if claimed is not None and (claimed + self.stale_after) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.update((None,))
            yield Row(job_id=key[0], at=claimed + self.stale_after, seq=None, outcome="stale")

    def close(self) -> None:
        pass


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", lateness)


def remember(events: DataFrame, ttl: int = TTL, lateness: str = "1 hour") -> DataFrame:
    """OUTCOMES of a stream of EVENTS: suppressed or searched for each ask, and expired, with the time, for each memory that runs out.

    Events of a person are taken by time within a batch; one that comes later than `lateness` after a newer event of any person is dropped by
    the watermark. Null ids of people are a person of their own. A find by any finder forgets what all remember.
    """
    return _timed(events, lateness).groupBy("tree_id", "person_id").transformWithState(Memory(ttl), OUTCOMES, "Append", "EventTime")


def claims(events: DataFrame, stale_after: int = STALE_AFTER, lateness: str = "1 minute") -> DataFrame:
    """CLAIMED of a stream of CLAIMS, as ledger.replay() has them (a release of a stale claim changes nothing), and stale for each claim that runs out."""
    return _timed(events, lateness).groupBy("job_id").transformWithState(Claims(stale_after), CLAIMED, "Append", "EventTime")
