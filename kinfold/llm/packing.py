"""Best-fit packing of token pieces into sequences, by the best-two-fit rule.

The packing depends on lengths alone, and there are at most `size` of them. So the number of pieces of each length (a
bounded histogram) is all that the packing needs; best-two-fit runs on it and yields patterns (the lengths in one
sequence, in order) with how often each is used. Pieces then find their places by rank: the r-th piece of a length goes to the
r-th place that the patterns have for that length. Ranks come from counts by (length, salt), at
most SALTS in all or SALT_PIECES pieces to each, so that a length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import store
from .textbytes import frugal

SALT_PIECES, SALTS = 1 << 9, 1 << 16
_ENCODERS: dict[str, object] = {}


def encoder(file: str):
    """The byte-level BPE that a tokenizers .json describes, as ranks of byte strings: the same ids in less time.

    As by the library's default, an added token's string inside a text is that token, and all else is split by the fixed pattern.
    """
    if file not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        with open(file, encoding="utf-8") as f:
            said = json.load(f)
        pre = said["pre_tokenizer"]
        if said["model"]["type"] != "BPE" or said["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{file} is no plain byte-level BPE")
        # The vocabulary writes each byte as one character: printable ones as themselves, the others from 256 on, in order.
        own = sorted(ord(c) for c in ByteLevel.alphabet() if ord(c) < 256)
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        added = {t["content"]: t["id"] for t in said["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in added}
        _ENCODERS[file] = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[file]


def ids_of(enc, text: str | None) -> np.ndarray:
    return np.asarray(enc.encode_to_numpy(text or "", allowed_special="all"), "<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens: all but the first have size, the first what is left."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def fewest(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """The patterns of best_two_fit() with the fewest sequences, of three rules for what an exchange may leave: any room, none, and no exchange at all. The first of equals."""
    return min((best_two_fit(counts, most) for most in (len(counts) - 1, 0, -1)), key=lambda patterns: sum(times for times, _ in patterns))


def best_two_fit(counts: np.ndarray, most_left: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times, lengths) that use counts[L] pieces of each length L below len(counts), none longer in sum than len(counts) - 1.

    A sequence is filled greedily, each time with the longest piece that fits. Then its shortest piece is taken out and
    two unpacked pieces that fit the gap more tightly are put in, if there are such; of these the pair that leaves the
    least room, and of equals the one with the longest piece. What was done for one sequence is done as often as the
    pieces last, so the work grows with the number of lengths, not of pieces. most_left: the room that an exchange may
    leave, any if not given: one that leaves some can take pieces that later sequences need.
    """
    left, size = counts.astype(np.int64).copy(), len(counts) - 1
    out = []
    live = np.flatnonzero(left)[::-1]  # lengths at hand, longest first
    while len(live):
        used: dict[int, int] = {}
        room, parts = size, []

        def free(n):
            return left[n] - used.get(n, 0) > 0

        for n in live:
            n = int(n)
            while n <= room and free(n):
                used[n] = used.get(n, 0) + 1
                parts.append(n)
                room -= n
        if room and len(parts) > 1:
            last = parts[-1]
            gap = room + last
            best = None
            low = [int(n) for n in live if n < gap]
            have = np.zeros(gap + 1, bool)
            have[[n for n in low if free(n)]] = True
            for a in low:
                if not have[a] or 2 * a < last + 1:
                    if 2 * a < last + 1:
                        break  # the longer of a tighter pair has over half of what is taken out
                    continue
                most = min(a, gap - a)
                fits = np.flatnonzero(have[: most + 1])
                b = int(fits[-1]) if len(fits) else 0
                if b == a and left[a] - used.get(a, 0) < 2:
                    b = int(fits[-2]) if len(fits) > 1 else 0
                if b and a + b > last and (best is None or a + b > sum(best)):
                    best = a, b
                    if a + b == gap:
                        break
            if best and (most_left is None or gap - sum(best) <= most_left):
                parts.pop()
                used[last] -= 1
                for n in best:
                    used[n] = used.get(n, 0) + 1
                    parts.append(n)
        times = int(min(left[n] // k for n, k in used.items() if k))
        for n, k in used.items():
            left[n] -= k * times
        out.append((times, tuple(parts)))
        live = live[left[live] > 0]
    return out


def places(patterns: list[tuple[int, tuple[int, ...]]], size: int) -> dict[str, np.ndarray]:
    """By length and rank: runs of places. first[r]: the rank at which run r begins; its pieces go to sequences seq[r] + rank - first[r], at offset[r]."""
    rank = np.zeros(size + 1, np.int64)
    rows, base = [], 0
    for times, parts in patterns:
        at = 0
        for n in parts:
            rows.append((n, rank[n], base, at))
            rank[n] += times
            at += n
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "first": cols[:, 1], "seq": cols[:, 2], "offset": cols[:, 3]}


def pieces_of(docs: DataFrame, file: str, size: int, end_id: int, text: str, row_id: str) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece, and deal, a number by which a task's pieces of one length spread."""

    def run(batches):
        enc, deal = encoder(file), (TaskContext.get().partitionId() * 0x9E3779B1) & 0xFFFFFFFF
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.append(ids_of(enc, t.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes()), deal))
                    deal += 1
            cols = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[:, 0], pa.int32()), *(pa.array(cols[:, k]) for k in (1, 2, 3, 4))], names=["id", "piece", "start", "length", "ids_crc32", "deal"])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), text).mapInArrow(frugal(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, deal long")


def pack(docs: DataFrame, file: str, size: int = 1024, end_id: int = 2, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Pieces of all docs with the sequence and the place of each: row_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and end_id, so null and empty texts are one token. Longer ones than size are cut into
    pieces of size tokens, the first of which may be shorter. Every piece is in exactly one sequence, and a sequence has no
    gaps and at most size tokens. Repeated rows are documents each (their pieces get places of their own); ids may be
    null; other columns play no part. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    found = store(pieces_of(docs, file, size, end_id, text, row_id), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most size rows
        counts[r.length] = r.n
    salts = np.maximum(1, -(-counts // max(SALT_PIECES, int(counts.sum()) // SALTS)))
    by_length = spark.createDataFrame([(n, int(salts[n])) for n in np.flatnonzero(counts).tolist()], "length long, salts long")
    dealt = found.join(F.broadcast(by_length), "length").withColumn("salt", F.pmod("deal", "salts"))
    # At most size + SALTS sums.
    first = np.concatenate([[0], np.cumsum(salts)])
    sums = np.zeros(first[-1], np.int64)
    for r in dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).collect():
        sums[first[r.length] + r.salt] = r.n
    before = np.cumsum(sums) - sums
    before -= np.repeat(before[first[:-1]], salts)
    runs = places(fewest(counts), size)
    shared = spark.sparkContext.broadcast((runs, first, before))  # in practice a few runs for each length
    order = Window.partitionBy("length", "salt").orderBy("deal", "id", "piece")
    ranked = dealt.withColumn("k", F.row_number().over(order))

    def run(batches):
        runs, first, before = shared.value
        at_length = np.searchsorted(runs["length"], np.arange(size + 2))
        for batch in batches:
            length, salt, k = (batch.column(batch.schema.names.index(x)).to_numpy(zero_copy_only=False) for x in ("length", "salt", "k"))
            rank = before[first[length] + salt] + k - 1
            r = np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                here = length == n
                a, b = at_length[n], at_length[n + 1]
                r[here] = a + np.searchsorted(runs["first"][a:b], rank[here], "right") - 1
            seq = runs["seq"][r] + rank - runs["first"][r]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(runs["offset"][r])], names=[row_id, *batch.schema.names[1:5], "sequence_id", "offset"])

    kind = docs.schema[row_id].dataType.simpleString()
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "salt", "k").mapInArrow(frugal(run), f"`{row_id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
