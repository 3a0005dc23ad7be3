"""Exact top-k search by aggregation without random access (NRA).

Vectors become integers. Candidates are dealt into blocks, queries into blocks, and a pair of blocks is one group of an
equi-join. In a group each component is a list of the candidates sorted by it; a query reads every list from the end that
adds most to its score, onward in STEPS steps. The products of what a step reads are added to what is known of each
candidate. With the lists' last values in place of what is not read, that is a lower bound of the score; with the last values read, an
upper bound. A candidate whose upper bound is under the k-th lower bound is out and costs nothing from then on. A query
stops when no more than a few are left, whose unread components are then added; at the lists' end both bounds are the score.

First each block of queries meets one block of candidates; its k-th scores are floors for the others. A block whose best
possible score is under a query's floor is skipped, and in the rest outsiders go sooner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, store

BLOCK, STEPS, QUERIES = 4096, 8, 512


def _kind(q: np.ndarray, c: np.ndarray):
    """A type in which all sums of products are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _some(q, own, floor, c, rank, lists, ids, k, steps, few):
    """nra() for a few queries; c, ids in order of ids. Yields (query, ids, scores, depth)."""
    (n, D), kind = c.shape, c.dtype
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    asked, cand = np.arange(len(q)), np.arange(n)  # queries and candidates that are not done
    known, alive = np.zeros((len(q), n), kind), ids != own[:, None]
    depths = sorted({-(-n * s // steps) for s in range(1, steps + 1)})
    for before, d in zip([0, *depths[:-1]], depths, strict=True):
        r, x, a, b = rank[cand], c[cand], up[asked], down[asked]
        high, low = r >= n - d, r < d  # read so far, from the lists' high ends and from their low ends
        known += a @ (x * (high & (r < n - before))).T + b @ (x * (low & (r >= before))).T
        unread_high, unread_low = (~high).astype(kind).T, (~low).astype(kind).T
        lower = known + (a * lists[0]) @ unread_high + (b * lists[-1]) @ unread_low
        upper = known + (a * lists[n - d]) @ unread_high + (b * lists[d - 1]) @ unread_low
        least = floor[asked]
        if len(cand) > k:
            bound = np.where(alive, lower, -np.inf)
            least = np.maximum(least, np.partition(bound, len(cand) - k, axis=1)[:, len(cand) - k])
        alive &= upper >= least[:, None]
        done = np.flatnonzero((alive.sum(1) <= few) | (d == n))
        for i in done.tolist():
            left = np.flatnonzero(alive[i])
            y = x[left]  # what is not read of the few is added; at the lists' end that is nothing
            s = known[i, left] + (y * ~high[left]) @ a[i] + (y * ~low[left]) @ b[i]
            best = np.array(sorted(range(len(left)), key=lambda t: (-s[t], ids[cand[left[t]]]))[:k], int)
            yield int(asked[i]), ids[cand[left[best]]], s[best].astype(np.int64), d / n
        stay = np.setdiff1d(np.arange(len(asked)), done)
        if not len(stay):
            return
        asked, known, alive = asked[stay], known[stay], alive[stay]
        live = alive.any(0)
        if live.mean() < 0.8:
            cand, known, alive = cand[live], known[:, live], alive[:, live]


def nra(q: np.ndarray, own: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, steps: int = STEPS, few: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """For each query (row of q; own: its id) its index, ids and scores of its k best candidates but itself, ties to smaller ids, and the depth to which it read (0: the block was skipped).

    floor: scores under it are not asked for. few: a query with no more candidates than that left stops.
    """
    floor = np.full(len(q), -np.inf) if floor is None else floor
    kind, few = _kind(q, c), 16 * k if few is None else few
    if not len(c):
        return []
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    best = (np.maximum(q, 0).astype(kind) * c.max(0) + np.minimum(q, 0).astype(kind) * c.min(0)).sum(1)
    meets = np.flatnonzero(best >= floor)
    none = np.zeros(0, np.int64)
    out = [(i, none, none, 0.0) for i in np.setdiff1d(np.arange(len(q)), meets).tolist()]
    if len(meets):
        rank = np.empty(c.shape, np.int32)
        np.put_along_axis(rank, np.argsort(c, axis=0, kind="stable"), np.arange(len(c), dtype=np.int32)[:, None], 0)
        c, lists = c.astype(kind), np.sort(c, axis=0).astype(kind)
        for a in range(0, len(meets), QUERIES):
            part = meets[a : a + QUERIES]
            out += [(int(part[i]), *x) for i, *x in _some(q[part], own[part], floor[part], c, rank, lists, ids, k, steps, few)]
    return out


#: Bands of a vector's length: four to a doubling of its square.
BANDS = 4
#: Pairs of blocks that are sent to all tasks; beyond that they are joined by a shuffle.
MOST_PAIRS = 1 << 18


def ranges_of(counts: dict[int, int], block: int) -> list[tuple[int, int, int, int, float]]:
    """Ranges of bands, longest vectors first: least band, greatest band, first block, number of blocks, and what no vector of it is longer than.

    Bands of few vectors make a range together, until it has half a block.
    """
    out, held, first = [], [], 0
    for band in sorted(counts, reverse=True):
        held.append(band)
        n = sum(counts[b] for b in held)
        if 2 * n >= block or band == min(counts):
            blocks = max(1, -(-n // block))
            out.append((held[-1], held[0], first, blocks, 2.0 ** ((held[0] + 1) / (2 * BANDS)) * (1 + 1e-9)))
            first, held = first + blocks, []
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, row_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each row whose id every divides.

    Each component x becomes floor(scale * x). Rows with null id, with null vector, or with a null or non-finite
    component take no part. Of rows with one id the least vector counts. Only vectors of one length are compared.
    Ties go to smaller ids; where fewer than k rows are there, all are returned; a query with none has no rows. Other
    columns play no part. An empty table gives an empty table.

    Candidates are dealt to blocks by their norm. Queries meet a block of the longest ones first; its k-th scores are floors, and
    a block goes only to queries whose own norm times its greatest one reaches their floor.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull() & ~bad)
    rows = rows.select(F.col(row_id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("square", square).withColumn("band", F.floor(F.log2(F.greatest("square", F.lit(1.0))) * BANDS).cast("int"))
    rows = store(rows, "vectors")
    found = rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("m")).collect()  # a row for each fourth of a doubling
    spans = ranges_of({r.band: r.n for r in found}, block)
    qb = max(1, -(-sum(r.m for r in found) // block))
    own_blocks = spans[0][3] if spans else 1
    hashed = lambda blocks: F.pmod(F.xxhash64("id"), blocks).cast("int")
    place = [x for low, high, first, blocks, _ in spans for b in range(low, high + 1) for x in (F.lit(b), F.struct(F.lit(first).alias("first"), F.lit(blocks).alias("blocks")))]
    at = F.element_at(F.create_map(*place), F.col("band")) if place else F.lit(None).cast("struct<first:int,blocks:int>")
    queries = rows.where(F.col("id") % every == 0).withColumn("qb", hashed(F.lit(qb)))
    candidates = rows.withColumn("at", at).withColumn("cb", F.col("at.first") + hashed(F.col("at.blocks"))).select("id", "v", "dim", "cb")

    def run(key, left, right):
        dim = key[2].as_py()
        get = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
        found = []
        if left.num_rows and right.num_rows:
            own, floor = left.column("id").to_numpy(), left.column("floor").to_numpy()
            found = [(own[i], i_, s) for i, ids, scores, _ in nra(get(left), own, get(right), right.column("id").to_numpy(), k, floor) for i_, s in zip(ids, scores, strict=True)]
        cols = np.array(found, np.int64).reshape(-1, 3)
        return pa.table({"query_id": cols[:, 0], "vec_id": cols[:, 1], "score": cols[:, 2]})

    def meet(queries, candidates, groups):
        # A pair of blocks is much work on few bytes, so tasks are not to be merged by size.
        deal = lambda t: t.repartition(max(1, min(groups, 1 << 14)), "qb", "cb", "dim").groupBy("qb", "cb", "dim")
        queries = queries.toDF(*queries.columns)  # both sides stem from one table
        return deal(queries).cogroup(deal(candidates)).applyInArrow(run, "query_id long, vec_id long, score long")

    # Block qb of the queries meets block qb of the longest candidates (modulo their number), then all others that may qualify.
    asked = queries.select("id", "v", "dim", "square", "qb").withColumn("floor", F.lit(float("-inf")))
    own = F.pmod("qb", F.lit(own_blocks)).cast("int")
    to_first = F.explode(F.filter(F.sequence(F.lit(0), F.lit(qb - 1)), lambda q: F.pmod(q, F.lit(own_blocks)) == F.col("cb")))
    best = meet(asked.withColumn("cb", own), candidates.where(F.col("cb") < own_blocks).withColumn("qb", to_first), qb)
    if sum(s[3] for s in spans) > 1:
        best = store(best, "first")
        floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("floor").alias("reached"))
        asked = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("reached", "floor")).drop("reached")
        of = F.array(*(F.struct(F.lit(first).alias("first"), F.lit(blocks).alias("blocks"), F.lit(most).alias("most")) for _, _, first, blocks, most in spans))
        reach = F.filter(of, lambda s: F.sqrt("square") * (1 + 1e-9) * s["most"] >= F.col("floor"))
        span = F.explode(reach).alias("span")
        asked = asked.select("*", span).withColumn("cb", F.explode(F.sequence(F.col("span.first"), F.col("span.first") + F.col("span.blocks") - 1))).where(F.col("cb") != own).drop("span")
        asked = store(asked, "asked")
        pairs = store(asked.select("qb", "cb").distinct(), "pairs")
        best = best.union(meet(asked, candidates.join(small(pairs, MOST_PAIRS), "cb"), pairs.count()))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
