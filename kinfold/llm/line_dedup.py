"""Line dedup: lines that many documents share are found in sharded minimal perfect hash tables.

Distinct line keys are counted once, dealt into shards by hash, and each shard becomes a minimal perfect hash that
indexes two compact arrays, fingerprints and counts. Documents send the packed hashes of their lines to the shards and
probe the arrays there; no row per line is ever joined. A shard holds about SHARD_KEYS keys whatever the input, and
is copied for every SHARD_PROBES look-ups, so a line that a third of all documents hold spreads over as many tasks as it needs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, small, store
from .textbytes import LOWER_TABLE, SPACE, U, frugal, mix

SHARD_KEYS, SHARD_PROBES, GAMMA, FLUSH = 1 << 16, 1 << 17, 2.0, 1 << 18
#: Shards of many look-ups that are sent to all tasks; beyond that they are joined by a shuffle.
MOST_BROADCAST = 1 << 18
#: Texts that lose lines, and their lines, that are sent to all tasks; beyond either the texts are dealt by key.
MOST_TEXTS, MOST_LINES = 1 << 19, 1 << 22


def line_keys(text: str | None) -> list[bytes]:
    """Per line of a text its key: ASCII white space stripped at both ends, A-Z lower-cased. No text is one empty line."""
    return [x.strip(SPACE) for x in (text or "").encode().translate(LOWER_TABLE).split(b"\n")]


def hash_of(key: bytes) -> int:
    return xxhash.xxh3_128_intdigest(key)


# ---- minimal perfect hash: levels of bit arrays, each key at the first level where it is alone ----


def build_mph(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> dict:
    """Arrays of one shard. hi, lo: the distinct 128-bit keys. counts are cut to 32 bits, which only orders them above any threshold."""
    levels, left, place = [], np.arange(len(hi)), np.zeros(len(hi), np.int64)
    base = 0
    while len(left):
        size = max(64, int(len(left) * GAMMA))
        at = (mix(hi[left] ^ (lo[left] * U(2 * len(levels) + 1))) % U(size)).astype(np.int64)
        hits = np.bincount(at, minlength=size)
        alone = hits[at] == 1
        bits = hits == 1
        rank = np.cumsum(bits) - 1
        place[left[alone]] = base + rank[at[alone]]
        levels.append(bits)
        base += int(bits.sum())
        left = left[~alone]
    prints, n = np.zeros(len(hi), U), np.zeros(len(hi), np.uint32)
    prints[place], n[place] = lo, np.minimum(counts, 0xFFFFFFFF)
    sizes = np.array([len(x) for x in levels], np.int64)
    bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
    return {"sizes": sizes.tobytes(), "bits": bits.tobytes(), "prints": prints.tobytes(), "counts": n.tobytes()}


class Mph:
    """Reads what build_mph() wrote."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8))[: int(self.sizes.sum())].astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.prints, self.counts = np.frombuffer(prints, U), np.frombuffer(counts, np.uint32)

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Documents of each key; 0 for a key that is not in the shard."""
        out, left, base = np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + (mix(hi[left] ^ (lo[left] * U(2 * level + 1))) % U(size)).astype(np.int64)
            here = self.bits[at]
            slot = self.rank[at[here]]
            out[left[here]] = np.where(self.prints[slot] == lo[left[here]], self.counts[slot], 0)
            left, base = left[~here], base + int(size)
        return out


# ---- tasks ----

_COUNTED = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])


def _count_lines(batches):
    """(text) -> (hi, lo, documents), summed within the task up to FLUSH keys."""
    seen: dict[int, int] = {}

    def out():
        raw = b"".join(k.to_bytes(16, "big") for k in seen)
        keys = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(U).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], schema=_COUNTED)

    for batch in batches:
        for text in batch.column(0):
            for k in {hash_of(x) for x in line_keys(text.as_py()) if x}:
                seen[k] = seen.get(k, 0) + 1
            if len(seen) >= FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


_SHARD = pa.schema([("shard", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary())])


def _build_shard(key, table):
    col = lambda name: table.column(name).combine_chunks().to_numpy()
    arrays = build_mph(col("hi").view(U), col("lo").view(U), col("n"))
    return pa.Table.from_pylist([{"shard": key[0].as_py(), **arrays}], schema=_SHARD)


_PROBE = pa.schema([("shard", pa.int64()), ("salt", pa.int32()), ("k1", pa.binary()), ("k2", pa.binary()), ("line", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary())])


def _probes(shards: int):
    def run(batches):
        """(k1, k2, text) -> packed line hashes by shard."""
        k1, k2, line, keys, flush = [], [], [], [], 0

        def out(flush):
            h = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(U)
            cols = np.array(k1, np.int64), np.array(k2, np.int64), np.array(line, np.int32)
            shard = (h[:, 0] % U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            salt = int(cols[0][0]) + flush
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int64()), pa.array([(salt + s) & 0x7FFFFFFF for s, _ in rows], pa.int32()), *(pa.array([x[o].tobytes() for _, o in rows], pa.binary()) for x in (*cols, h[:, 0], h[:, 1]))],
                schema=_PROBE,
            )

        for batch in batches:
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, x in enumerate(line_keys(text.as_py())):
                    if x:
                        k1.append(a)
                        k2.append(b)
                        line.append(i)
                        keys.append(hash_of(x).to_bytes(16, "big"))
                if len(keys) >= FLUSH:
                    yield out(flush)
                    flush += 1
                    for x in (k1, k2, line, keys):
                        x.clear()
        if keys:
            yield out(flush)

    return run


_DROPS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("line", pa.int32())])


def _probe(min_docs: int):
    def run(batches):
        """Sorted by shard, its arrays first and then its probes -> the lines to drop of each text, once per row of probes. One shard is held at a time."""
        last, mph = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if r["sizes"] is not None:
                    last, mph = r["shard"], Mph(r["sizes"], r["bits"], r["prints"], r["counts"])
                    continue
                assert last == r["shard"], "every line was counted, so every probe has a shard"
                at = np.flatnonzero(mph.count(np.frombuffer(r["hi"], U), np.frombuffer(r["lo"], U)) >= min_docs)
                if len(at):
                    k1, k2, line = (np.frombuffer(r[k], t)[at] for k, t in (("k1", np.int64), ("k2", np.int64), ("line", np.int32)))
                    order = np.lexsort((line, k2, k1))
                    k1, k2, line = k1[order], k2[order], line[order]
                    new = np.concatenate([[True], (np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(line) != 0)])  # copies of a text have equal keys
                    yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (k1, k2, line)], schema=_DROPS)

    return run


_KEPT = [("__ld_lines", pa.int64()), ("__ld_dropped", pa.int64()), ("__ld_kept", pa.string()), ("__ld_sha", pa.string())]


def _rebuild(batches, texts: bool):
    """Adds to each row its counts, kept text (if asked for) and digest."""
    for batch in batches:
        names = batch.schema.names
        lines, dropped, kept, sha = [], [], [], []
        for text, drop in zip(batch.column(names.index("__ld_text")), batch.column(names.index("__ld_drop")).to_pylist(), strict=True):
            x = (text.as_py() or "").split("\n")
            n = len(x)
            if drop:
                gone = set(drop)
                x = [y for i, y in enumerate(x) if i not in gone]
            lines.append(n)
            dropped.append(n - len(x))
            x = "\n".join(x)
            kept.append(x if texts else None)
            sha.append(hashlib.sha256(x.encode()).hexdigest())
        keep = [i for i, name in enumerate(names) if name not in ("__ld_text", "__ld_drop")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), *(pa.array(x, t) for x, (_, t) in zip((lines, dropped, kept, sha), _KEPT, strict=True))],
            schema=pa.schema([*(batch.schema.field(i) for i in keep), *(pa.field(*f) for f in _KEPT)]),
        )


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, out: tuple[str, str, str, str] = ("n_lines", "n_dropped", "kept_text", "kept_sha256"), keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """docs with line counts, the text without lines whose key at least min_docs rows hold, and that text's SHA-256.

    Null text is one empty line; blank lines have no key and always stay; a line repeated in a row counts once for it,
    repeated rows are documents each; equal rows get equal results. All columns of docs (or those in keep) are returned;
    a column of docs with the name of an output column is replaced. Other columns, null ids included, play no part.
    An empty table gives an empty table. texts=False leaves the kept text null.
    """
    src = docs.withColumns({"__ld_k1": F.xxhash64(F.lit(1), text), "__ld_k2": F.xxhash64(F.lit(2), F.reverse(F.coalesce(F.col(text), F.lit(""))), F.length(text))})
    counted = docs.select(text).mapInArrow(frugal(_count_lines), "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    counted = lines = store(counted, "lines")
    shards = max(16, -(-counted.count() // SHARD_KEYS))
    # The shard is the unsigned remainder of hi, as in _probes.
    unsigned = F.col("hi").cast("decimal(20,0)") + F.when(F.col("hi") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    counted = counted.withColumn("shard", (unsigned % F.lit(shards).cast("decimal(20,0)")).cast("long"))
    # A line is looked up about as often as it has documents; shards of very many look-ups go to several tasks.
    hot = counted.groupBy("shard").agg(F.ceil(F.sum("n") / SHARD_PROBES).cast("int").alias("salts")).where("salts > 1")
    hot, salts = small(store(hot, "hot"), MOST_BROADCAST), F.coalesce("salts", F.lit(1))
    tables = counted.select("hi", "lo", "n", "shard").groupBy("shard").applyInArrow(_build_shard, "shard long, sizes binary, bits binary, prints binary, counts binary")
    tables = tables.join(hot, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    probes = src.select("__ld_k1", "__ld_k2", text).mapInArrow(frugal(_probes(shards)), "shard long, salt int, k1 binary, k2 binary, line binary, hi binary, lo binary")
    probes = probes.join(hot, "shard", "left").withColumn("salt", F.pmod("salt", salts)).drop("salts")
    drops = (
        tables.unionByName(probes, allowMissingColumns=True)
        .repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", F.col("sizes").isNull())
        .mapInArrow(frugal(_probe(min_docs)), "k1 long, k2 long, line int")
        .distinct()  # a text's group has its own lines, however many copies there are
        .groupBy("k1", "k2")
        .agg(F.collect_list("line").alias("__ld_drop"))
    )
    # A table of its own, so that the join below deals texts by key for itself alone and can split a text of very many copies.
    drops = store(drops, "drops").withColumnsRenamed({"k1": "__ld_k1", "k2": "__ld_k2"})
    drop_stored(lines)
    texts_hit, lines_hit = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("__ld_drop")), F.lit(0))).first()
    # Where few enough texts lose lines these go to the texts; else texts move.
    drops = F.broadcast(drops) if texts_hit <= MOST_TEXTS and lines_hit <= MOST_LINES else drops.hint("merge")
    kept = [c for c in (keep if keep is not None else docs.columns)]
    both = src.join(drops, ["__ld_k1", "__ld_k2"], "left").select(*kept, F.col(text).alias("__ld_text"), "__ld_drop")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name not in ("__ld_text", "__ld_drop"))
    done = both.mapInArrow(frugal(lambda batches: _rebuild(batches, texts)), f"{types + ', ' if types else ''}__ld_lines long, __ld_dropped long, __ld_kept string, __ld_sha string")
    return done.drop(*(c for c in out if c in kept)).withColumnsRenamed(dict(zip([f[0] for f in _KEPT], out, strict=True)))
