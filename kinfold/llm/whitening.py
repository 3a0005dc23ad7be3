"""Whitening of embeddings by a one-sided Jacobi SVD of the R that a blockwise TSQR leaves of the centred rows.

No covariance matrix is formed to find the components: each task reduces its centred rows, block by block, to a
triangle R; triangles are stacked and reduced again, a fan of them a task, until one is left. Plane rotations then
make R's columns orthogonal: the rotations together are the components, the columns' lengths the singular values. So
small standard deviations keep their digits, which the squares of a covariance would lose.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, store
from .textbytes import frugal

#: Triangles that one task stacks, and rows of a block.
FAN, ROWS = 32, 4096
#: Entries are kept exact, as integers of at most this size.
MOST = 1 << 52
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


@dataclass
class Whitening:
    """n distinct vectors with sums S; components (columns) of deviation sigma; explained shares; the identity's error."""

    n: int
    sums: list[int]
    components: np.ndarray
    sigma: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def __post_init__(self):
        self.base = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)  # nearest to the mean
        self.over = [s - self.n * int(b) for s, b in zip(self.sums, self.base, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the integer part is subtracted exactly, before anything is rounded."""
        return (x - self.base) - np.array(self.over, float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / self.sigma)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; None where a long cannot hold it."""
        z = np.abs(x - self.base).max(1, initial=0).astype(float) * self.n + self.n
        safe = z * z * x.shape[1] < 2.0**62
        out: list[int | None] = np.square((x[safe] - self.base) * self.n - np.array(self.over, np.int64)).sum(1).tolist() if safe.any() else []
        if safe.all():
            return out
        done = iter(out)
        wide = lambda row: sum(((int(v) - int(b)) * self.n - o) ** 2 for v, b, o in zip(row, self.base, self.over, strict=True))
        exact = (next(done) if s else wide(row) for s, row in zip(safe, x, strict=True))
        return [v if v < 1 << 63 else None for v in exact]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of r: its columns made orthogonal by plane rotations.

    A round turns disjoint pairs of columns at once; a sweep's rounds meet every pair (a round-robin tournament). It ends
    when no pair of a whole sweep is further from orthogonal than rounding.
    """
    d = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    u, v = np.array(r[:, order], float), np.eye(d)[:, order]
    ring, tol = np.arange(d + d % 2), np.finfo(float).eps * max(4, d**0.5)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < d], q[q < d]
            a, b = u[:, p], u[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(gamma) > tol * np.sqrt(alpha) * np.sqrt(beta)
            if turn.any():
                turned = True
                p, q, a, b = p[turn], q[turn], a[:, turn], b[:, turn]
                zeta = (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                u[:, p], u[:, q] = c * a - s * b, s * a + c * b
                x, y = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    else:
        raise ArithmeticError("rotations did not converge")
    size = np.linalg.norm(u, axis=0)
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order]


def integers(col: pa.Array, scale: int, shift: int):
    """By length of vector: the rows of an array<double> column that have one, and floor(scale * c) + shift of their entries. Rows that are null or hold a null or non-finite entry are left out."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    at = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    whole = (bad[at[1:]] == bad[at[:-1]]) & (size > 0)
    for d in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == d))
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            x = np.floor(scale * flat[at[part][:, None] + np.arange(d)])
            yield int(d), part, np.clip(x, -MOST, MOST).astype(np.int64) + shift


def pack(x: np.ndarray, shift: int) -> list[bytes]:
    """Each row in the narrowest integers that hold it: equal rows have equal bytes."""
    y = x - shift
    most = np.maximum(y.max(1), ~y.min(1))
    kind = np.searchsorted([1 << 7, 1 << 15, 1 << 31], most, "right")
    out: list[bytes] = [b""] * len(x)
    for k in np.unique(kind):
        raw, wide, rows = y[kind == k].astype(_WIDTHS[k]).tobytes(), (1 << k) * x.shape[1], np.flatnonzero(kind == k)
        for i, r in enumerate(rows.tolist()):
            out[r] = raw[i * wide : (i + 1) * wide]
    return out


def unpack(col: pa.Array, dims: np.ndarray, shift: int):
    """Blocks (d, x) of what pack() wrote. The width of an entry is that of the bytes over the dimension."""
    rows = col.to_pylist()
    kind = np.array([len(b) for b in rows], np.int64) // dims
    for d, w in sorted(set(zip(dims.tolist(), kind.tolist(), strict=True))):
        here = np.flatnonzero((dims == d) & (kind == w))
        for k in range(0, len(here), ROWS):
            part = here[k : k + ROWS].tolist()
            yield d, np.frombuffer(b"".join(rows[i] for i in part), f"<i{w}").reshape(-1, d).astype(np.int64) + shift


def _distinct(scale: int, shift: int):
    def run(batches):
        for batch in batches:
            found = {(d, b) for d, _, x in integers(batch.column(0), scale, shift) for b in pack(x, shift)}
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["d", "x"])

    return run


def _blocks(batches, shift: int):
    for batch in batches:
        yield from unpack(batch.column(1), batch.column(0).to_numpy(), shift)


def _sums(shift: int):
    """(d, i, n, high, low): the sum of entry i is high * 2 ** 26 + low."""

    def run(batches):
        total: dict[int, list] = {}
        for d, x in _blocks(batches, shift):
            n, high, low = total.get(d, (0, 0, 0))
            total[d] = [n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)]
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["d", "i", "n", "high", "low"])

    return run


_TRIANGLE = "d int, part int, r binary"


def _rows_of(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in found], pa.int32()), pa.array([p for _, p, _ in found], pa.int32()), pa.array([r.tobytes() for _, _, r in found], pa.binary())], names=["d", "part", "r"])


def _triangles(shared, shift: int):
    """The R of each task's centred rows, by d."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for d, x in _blocks(batches, shift):
            y = shared.value[d].centred(x)
            held[d] = np.linalg.qr(np.vstack([held[d], y]) if d in held else y, mode="r")
        if held:
            yield _rows_of([(d, TaskContext.get().partitionId(), r) for d, r in held.items()])

    return run


def _stack(key, table):
    d, part, held = key[0].as_py(), key[1].as_py(), None
    for raw in table.column("r"):
        r = np.frombuffer(raw.as_py()).reshape(-1, d)
        held = r if held is None else np.linalg.qr(np.vstack([held, r]), mode="r")
    return pa.Table.from_batches([_rows_of([(d, part, held)])])


def _moments(shared, shift: int):
    """(d, i, j, v): sums of products of whitened entries i and j; j = -1: the sum of entry i."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for d, x in _blocks(batches, shift):
            w = shared.value[d].whitened(x)
            total[d] = total.get(d, 0) + np.column_stack([w.sum(0), w.T @ w])
        for d, m in total.items():
            i, j = np.divmod(np.arange(m.size), m.shape[1] or 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32) - 1), pa.array(m.ravel())], names=["d", "i", "j", "v"])

    return run


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 16, scale: int = 64, shift: int = 1_000_000) -> dict[int, Whitening]:
    """The whitening of vectors, by their length (each length is a space of its own). What returns to the driver is bounded by the square of the length, whatever the rows.

    Fitted is each distinct vector once. A component without variance, up to rounding, is none: so a fit list of one vector has none.
    """
    spark = vectors.sparkSession
    fits = store(vectors.select(F.col(vector).cast("array<double>")).mapInArrow(frugal(_distinct(scale, shift)), "d int, x binary").distinct(), "fit")
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in fits.mapInArrow(frugal(_sums(shift)), "d int, i int, n long, high long, low long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        sums.setdefault(r.d, {})[r.i] = r.n, (r.high << 26) + r.low
    none = np.zeros(0)
    models = {d: Whitening(s[0][0], [s[i][1] for i in range(d)], np.zeros((d, 0)), none, none) for d, s in sums.items()}
    shared = spark.sparkContext.broadcast(models)
    parts = store(fits.mapInArrow(frugal(_triangles(shared, shift)), _TRIANGLE), "triangles")
    left, tree = 1 + (parts.agg(F.max("part")).first()[0] or 0), parts
    while left > 1:
        tree = tree.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("d", "part").applyInArrow(_stack, _TRIANGLE)
        left = -(-left // FAN)
    for row in tree.collect():  # one a length
        m, d = models[row.d], row.d
        size, v = jacobi(np.frombuffer(row.r).reshape(-1, d))
        live = int((size > size[0] * d * np.finfo(float).eps).sum()) if size[0] > 0 else 0
        live = min(live, m.n - 1, k)
        m.components, m.sigma, m.explained = v[:, :live], size[:live] / m.n**0.5, size[:live] ** 2 / (size**2).sum() if live else none
    shared = spark.sparkContext.broadcast(models)
    found: dict[int, dict[tuple[int, int], float]] = {}
    for r in fits.mapInArrow(frugal(_moments(shared, shift)), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.d, {})[r.i, r.j] = r.v
    for d, x in found.items():
        m, live = models[d], len(models[d].sigma)
        cov = np.array([[x[i, j] / m.n - x[i, -1] * x[j, -1] / m.n**2 for j in range(live)] for i in range(live)])
        m.identity_error = float(np.abs(cov - np.eye(live)).max(initial=0.0))
    drop_stored(parts)
    drop_stored(fits)
    return models


def whiten(vectors: DataFrame, k: int = 16, row_id: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, models: dict[int, Whitening] | None = None) -> DataFrame:
    """row_id, component, n, deviation, whitened, explained, identity_error: up to k rows for each vector.

    Each entry c becomes the integer x = floor(scale * c) + shift (kept within 2 ** 52); vectors that are null, empty or
    hold a null or non-finite entry have no rows. Components are fitted on each distinct x once (or given as models) and
    numbered from 1 by falling variance; those without variance are left out, so equal vectors alone give no rows.
    Repeated rows have rows each, null ids as well; vectors of different lengths are whitened apart; ties of variance
    give some orthonormal basis, one for all rows. deviation is null where a long cannot hold it. Other columns play no
    part. An empty table gives an empty table.
    """
    models = fit(vectors, vector, k, scale, shift) if models is None else models
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for d, rows, x in integers(batch.column(1), scale, shift):
                m = shared.value.get(d)
                live = len(m.sigma) if m else 0
                if live:
                    each = lambda v, t: pa.array(np.tile(v, len(rows)), t)
                    deviation = pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), live)))
                    cols = [batch.column(0).take(pa.array(np.repeat(rows, live))), each(np.arange(1, live + 1), pa.int32()), each([m.n] * live, pa.int64()), deviation]
                    cols += [pa.array(m.whitened(x).ravel()), each(m.explained, pa.float64()), each([m.identity_error] * live, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=[row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[row_id].dataType.simpleString()
    out = f"`{row_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select(row_id, F.col(vector).cast("array<double>").alias("__wh")).mapInArrow(frugal(run), out)
