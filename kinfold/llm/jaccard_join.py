"""N-gram Jaccard join with set-relation skipping.

Every document's set is the 64-bit hashes of its word shingles; equal sets are one class, so copies are never paired.
Two sets that link must share a token among the first n - ceil(t n) + 1 of each, in any order that holds for all sets;
here tokens that many sets hold come last, by their number, and tokens of one set alone come first, so that few shingles that meet by
chance are in a prefix: their pairs grow as the square of the input. A bitmap of bounded size tells tokens that may come twice; all
others find nobody and are not sent. Prefix postings travel as packed arrays, dealt by token.

Skipping in an index list: its sets are sorted by size and cut into blocks. A set's slack is what its remaining length (what is
behind the token's position) allows a partner's size to be; a block whose best slack reaches no other block's
least size, or that no other block's best slack reaches, is skipped as a whole.
Skipping between sets: candidates gather around a lead, the set most of them are candidates of. Each member's overlap with the
lead is computed once as a mask; the answers among members follow from the masks plus the few tokens outside the lead.
Sets that are in one component by then are not compared again.

Pairs of short lists are ruled out by parity bitmaps first: bits in which they differ are at most the tokens in which the sets
differ. Lists longer than Limits.long are never paired up: their live sets become members of a hub, the list's first set by hash, which is
mostly the same for all lists of a group of near copies. A hub's members meet in groups of a bounded size. What is
then still in different components is dealt into blocks by size and hash, and blocks of sets outside of the
hub's largest component meet all blocks of sizes in reach. Every group returns only links that join components, fewer than
it has sets, so a group of near copies gives rows by its size, not its square, and no link between components is lost.

Sets are named by a 64-bit hash; names that two sets share are found by a second one and told apart, so that
sets are confused only if 128 bits agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, drop_stored, small, store
from .textbytes import U, frugal, groups, mix, shingle_sets, text_bytes

BLOCK, FLUSH, COUNT_FLUSH = 16, 1 << 18, 1 << 21
#: Bits by which the tokens of a bucket are counted: a few that share them count as one.
LOW = 24


@dataclass(frozen=True)
class Limits:
    """Sizes that steer the work; results do not depend on them."""

    long: int = 16  # sets of a longer index list meet at a hub
    group: int = 192  # sets to a group around a lead, about
    group_tokens: int = 1 << 20  # and tokens
    grid: int = 512  # sets to a block of a hub, about
    grid_tokens: int = 1 << 19  # and tokens
    slice: int = 1 << 13  # members of a hub to a row, about
    hot: int = 4  # tokens of so many sets come last in the order, by their number
    max_hot: int = 1 << 18  # of such tokens, at most so many (the most frequent) are known to all tasks, 4 MB, and all that are dealt into parts
    cell_bits: int = 29  # of the bitmap of tokens that may come twice: at most 2 ** 29 cells (64 MB), else one for two shingles
    hot_part: int = 1 << 16  # postings of one token to a part, at least; at most 2 ** 20 tokens (16 MB) are dealt into parts
    bucket: int = 1 << 18  # postings to a bucket, about
    seen: int = 1 << 16  # names that a task remembers, to leave out copies
    name_bits: int = 64
    broadcast: int = 1 << 20  # sets of candidates, 16 to 40 bytes each, that are sent to all tasks to pick their texts; more are joined by a shuffle


def name_of(tokens: np.ndarray, bits: int = 64) -> int:
    """A set's name, as a signed 64-bit integer."""
    x = mix(np.add.reduce(mix(tokens ^ U(0x5851F42D4C957F2D)), keepdims=True) + U(len(tokens)))
    return int((x >> U(64 - bits)).view(np.int64)[0])


def check_of(tokens: np.ndarray) -> int:
    """A second hash, by which sets of one name are told apart."""
    return int(mix(np.add.reduce(mix(tokens + U(0x2545F4914F6CDD1D)), keepdims=True) ^ U(len(tokens))).view(np.int64)[0])


def namer(bits: int, clashes: dict[tuple[int, int], int]):
    def of(tokens):
        name = name_of(tokens, bits)
        return clashes.get((name, check_of(tokens)), name) if clashes else name

    return of


def needed(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b that link: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def sets_of(batch_column, width: int):
    raw, offs = text_bytes(batch_column)
    for i, j in groups(offs):
        yield from zip(range(i, j), shingle_sets(raw, offs[i : j + 1], width), strict=True)


def parity(s: np.ndarray) -> bytes:
    """Which remainders modulo a power of two, about the set's size, an odd number of tokens has."""
    bits = 1 << max(6, len(s).bit_length())
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int, num: int, den: int) -> bool:
    """False only if sets of sizes n and m with these parities cannot link."""
    if den * min(n, m) < num * max(n, m):
        return False
    x, y = int.from_bytes(a), int.from_bytes(b)
    size = len(a)
    if len(b) > len(a):
        x, y, size = y, x, len(b)
    while size > min(len(a), len(b)):  # the larger one, folded
        size //= 2
        x = (x >> 8 * size) ^ (x & ((1 << 8 * size) - 1))
    return (x ^ y).bit_count() <= n + m - 2 * needed(n, m, num, den)


def _describe(width, name_bits):
    def run(batches):
        """(id, key, text) -> (id, key, size, name, check, parity)."""
        for batch in batches:
            n, names, checks = np.zeros((3, batch.num_rows), np.int64)
            bits = [None] * batch.num_rows
            for i, s in sets_of(batch.column(2), width):
                if len(s):
                    n[i], names[i], checks[i], bits[i] = len(s), name_of(s, name_bits), check_of(s), parity(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(names, mask=n == 0), pa.array(checks), pa.array(bits, pa.binary())], names=["id", "key", "n", "name", "check", "bits"])

    return run


# ---- frequent tokens ----


def gaps_of(x: np.ndarray) -> bytes:
    """Sorted numbers of at most 24 bits as gaps: how many; the low bits of all, as many as suit the mean gap; then the rest of each as so many zeros and a one.

    A gap takes about two bits more than the logarithm of the mean, however far apart the numbers are.
    """
    if not len(x):
        return b""
    gaps = np.diff(x.astype(np.int64), prepend=0).astype(np.uint32)
    k = max(0, int(x[-1] * 0.7 / len(x)).bit_length() - 1)
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint32) & np.uint32(1)).astype(bool)
    at = np.cumsum((gaps >> np.uint32(k)).astype(np.int64) + 1) - 1
    high = np.zeros(int(at[-1]) + 1, bool)
    high[at] = True
    return np.array([len(x), k], np.uint32).tobytes() + np.packbits(low).tobytes() + np.packbits(high).tobytes()


def from_gaps(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint32)
    n, k = (int(v) for v in np.frombuffer(packed, np.uint32, 2))
    bits, size = np.frombuffer(packed, np.uint8, offset=8), -(-n * k // 8)
    low = np.unpackbits(bits[:size], count=n * k).reshape(n, k)
    at = np.flatnonzero(np.unpackbits(bits[size:]))
    gaps = (np.diff(at, prepend=-1) - 1) << k
    for i in range(k):
        gaps += low[:, i].astype(np.int64) << i
    return np.cumsum(gaps).astype(np.uint32)


def _count_blobs(width, bits, remember):
    def run(batches):
        """(text) -> (bucket, packed tokens). Copies that the task remembers are left out: a set counts once."""
        have, size, seen = [], 0, set()

        def out():
            x = np.concatenate(have)
            have.clear()
            x.sort()
            cuts = np.searchsorted(x, np.arange(1 << bits, dtype=U) << U(64 - bits)).tolist() + [len(x)]
            low = (x >> U(64 - LOW - bits)).astype(np.int64) & ((1 << LOW) - 1)
            rows = [(b, gaps_of(low[p:q])) for b, (p, q) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if q > p]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.binary())], names=["bucket", "tokens"])

        for batch in batches:
            for _, s in sets_of(batch.column(0), width):
                if not len(s) or (name := (name_of(s), check_of(s))) in seen:
                    continue
                if len(seen) < remember:
                    seen.add(name)
                have.append(s)
                size += len(s)
                if size >= COUNT_FLUSH:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


def repeated_cells(low: np.ndarray, n: np.ndarray, width: int) -> tuple[bytes, bool]:
    """A bitmap of 2 ** width cells of a bucket: those of tokens that come more than once. Where these are more than the cells, the most frequent ones, and false: others may come twice as well."""
    least, most = 2, 1 << width
    if np.count_nonzero(n >= least) > most:
        least = int(np.partition(n, -most - 1)[-most - 1]) + 1
    cells = np.zeros(1 << width, bool)
    cells[low[n >= least] >> np.uint32(LOW - width)] = True
    return np.packbits(cells).tobytes(), least == 2


def is_repeated(s: np.ndarray, cells: np.ndarray, cell_bits: int) -> np.ndarray:
    """Which tokens of a set have their cell marked; a cell's number is a token's first bits."""
    at = s >> U(64 - cell_bits)
    return (cells[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8) & 1).astype(bool)


def _frequent(least, width):
    def run(key, table):
        """All tokens of a bucket -> the frequent ones, and one row with the bucket's cells (token: the bucket)."""
        x = np.sort(np.concatenate([from_gaps(b.as_py()) for b in table.column("tokens")]))
        at = np.flatnonzero(np.concatenate([[True], np.diff(x) > 0]))
        n = np.diff(np.append(at, len(x)))
        hot = n >= least
        low, n, bucket = x[at], n.astype(np.int64), np.int64(key[0].as_py())
        cells, whole = repeated_cells(low, n, width)
        none = [None] * int(hot.sum())
        return pa.table({
            "token": np.append((bucket << LOW) | low[hot].astype(np.int64), bucket), "n": pa.array([*n[hot].tolist(), None], pa.int64()),
            "cells": pa.array([*none, cells], pa.binary()), "whole": pa.array([*none, whole], pa.bool_()),
        })

    return run


# ---- prefix postings and index lists ----


def ordered_prefix(s: np.ndarray, bits: int, hot: np.ndarray, place: np.ndarray, cells: np.ndarray, cell_bits: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a sorted set: first the tokens whose cell is not marked, the frequent ones last, by their place. For each the index in hot, or -1; and how many are of the first kind."""
    p = prefix_length(len(s), num, den)
    short = (s >> U(64 - LOW - bits)).astype(np.int64)
    at = np.minimum(np.searchsorted(hot, short), max(0, len(hot) - 1))
    is_hot = hot[at] == short if len(hot) else np.zeros(len(s), bool)
    rare = s[~is_hot]
    twice = is_repeated(rare, cells, cell_bits)
    single = min(p, len(rare) - int(twice.sum()))
    rare = np.concatenate([rare[~twice], rare[twice]])[:p]
    at = at[is_hot]
    late = np.lexsort((s[is_hot], place[at]))[: p - len(rare)]
    return np.concatenate([rare, s[is_hot][late]]), np.concatenate([np.full(len(rare), -1), at[late]]), single


_POST = ["bucket", "part", "token", "name", "n", "rest"]


def _postings(width, hot_bits, bits, hot, cell_bits, whole, num, den, hot_part, names_of, remember):
    def run(batches):
        """(text) -> (bucket, part, packed postings). rest: tokens of the set from this position on, this one included. Tokens of one set alone are left out, if that is certain (whole)."""
        tokens, parts, names, sizes, lengths, skipped, size, seen = [], [], [], [], [], [], 0, set()
        keys, counts, cells = hot.value
        places = np.empty(len(keys), np.int64)
        places[np.lexsort((keys, counts))] = np.arange(len(keys))

        def out():
            tok = np.concatenate(tokens)
            length = np.array(lengths, np.int64)
            n = np.repeat(np.array(sizes, np.int32), length)
            name = np.repeat(np.array(names, np.int64), length)
            before = np.cumsum(length) - length - np.array(skipped, np.int64)
            rest = n - (np.arange(len(tok)) - np.repeat(before, length)).astype(np.int32)
            bucket = (tok >> U(64 - bits)).astype(np.int64)
            low = (tok >> U(32 - bits)).astype(np.uint32)
            part = np.concatenate(parts)
            place = bucket * (1 << 20) + part
            order = np.argsort(place, kind="stable")
            where = place[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
            pick = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            first = where[cut[:-1]]
            return pa.RecordBatch.from_arrays([pa.array((first >> 20).astype(np.int32)), pa.array((first & ((1 << 20) - 1)).astype(np.int32)), pick(low), pick(name), pick(n), pick(rest)], names=_POST)

        for batch in batches:
            for _, s in sets_of(batch.column(0), width):
                if not len(s) or (name := names_of(s)) in seen:
                    continue
                if len(seen) < remember:
                    seen.add(name)
                tok, at, single = ordered_prefix(s, hot_bits, keys, places, cells, cell_bits, num, den)
                single = single if whole else 0
                if single == len(tok):
                    continue
                tok, at = tok[single:], at[single:]
                # A token of very many sets is dealt into parts; part 0 is everything else.
                split = np.where(at >= 0, counts[at] // hot_part if len(counts) else 0, 0)
                parts.append(np.where(split > 0, 1 + (name & 0x7FFFFFFF) % np.maximum(split, 1), 0))
                tokens.append(tok)
                names.append(name)
                sizes.append(len(s))
                lengths.append(len(tok))
                skipped.append(single)
                size += len(tok)
                if size >= FLUSH:
                    yield out()
                    tokens, parts, names, sizes, lengths, skipped, size = [], [], [], [], [], [], 0
        if size:
            yield out()

    return run


def slack_of(n: np.ndarray, rest: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets x and y can reach the overlap they need from these positions on only if slack x >= num * n y and slack y >= num * n x."""
    return (num + den) * rest - num * n


def live(n: np.ndarray, rest: np.ndarray, num: int, den: int) -> np.ndarray:
    """For the sets of one list, sorted by size: false for those in blocks that can have no partner, by size and position."""
    L, slack = len(n), slack_of(n, rest, num, den)
    starts = np.arange(0, L, BLOCK)
    low, high = n[starts], n[np.minimum(starts + BLOCK, L) - 1]
    most = np.maximum.reduceat(slack, starts)
    alive = np.zeros(len(starts), bool)
    ends = np.searchsorted(num * low, den * high, "right")  # blocks of larger sizes that can still link
    for i, end in enumerate(ends.tolist()):
        ok = (most[i] >= num * low[i:end]) & (most[i:end] >= num * low[i])
        if starts[i] == L - 1:
            ok[0] = False  # one set has no partner in its own block
        if ok.any():
            alive[i] = True
            alive[i:end] |= ok
    return np.repeat(alive, BLOCK)[:L]


_FOUND = "kind int, a long, b long, rank long, slice int, members binary"
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("rank", pa.int64()), ("slice", pa.int32()), ("members", pa.binary())])


def first_of(names: np.ndarray) -> tuple[int, int]:
    """The set that leads wherever it is, so that a group of near copies has few hubs; and its rank."""
    rank = (mix(names.view(U)) >> U(1)).view(np.int64)
    at = int(rank.argmin())
    return int(names[at]), int(rank[at])


def sliced(names: np.ndarray, size: int):
    """Distinct names dealt by their own bits into slices of about size: (slice, packed names)."""
    slices = 1 << max(0, (len(names) // size).bit_length())
    to = names & (slices - 1)
    for k in np.unique(to).tolist():
        yield slices + k, names[to == k].tobytes()


def _lists(num, den, lim):
    def run(key, table):
        """All postings of a bucket -> candidate pairs of short lists (kind 0, a and b), members of a hub (kind 1, a), members of a split list (kind 2, of token a, with b their first)."""
        col = lambda c, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)])
        token, name, n, rest = col("token", np.uint32), col("name", np.int64), col("n", np.int32), col("rest", np.int32)
        order = np.argsort(token)
        run_at = np.flatnonzero(np.concatenate([[True], np.diff(token[order]) > 0]))
        run_size = np.diff(np.append(run_at, len(order)))
        split = key[1].as_py() > 0
        if not split:  # in a split list's part a set that is alone still has the other parts to meet
            order = order[np.repeat(run_size > 1, run_size)]  # tokens of one set are most of all
        order = order[np.lexsort((name[order], rest[order], n[order], token[order]))]
        if len(order):
            same = np.concatenate([[False], (np.diff(name[order]) == 0) & (np.diff(token[order]) == 0)])
            order = order[~same]  # a class that several tasks have met
        token, name, n, rest = token[order], name[order], n[order].astype(np.int64), rest[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], np.diff(token) > 0])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(token)))
        # Short lists all together, by distance in the list.
        short = (size <= lim.long) & (not split)
        rows, slack = np.repeat(short, size), slack_of(n, rest, num, den)
        ends, i = np.repeat(at + size, size), np.flatnonzero(rows)
        pairs = [np.zeros((0, 2), np.int64)]
        for d in range(1, lim.long):
            i = i[i + d < ends[i]]
            i = i[den * n[i] >= num * n[i + d]]  # farther ones are larger still
            if not len(i):
                break
            ok = i[(slack[i] >= num * n[i + d]) & (slack[i + d] >= num * n[i])]
            pairs.append(np.stack([name[ok], name[ok + d]], 1))
        p = np.concatenate(pairs)
        p = np.unique(np.sort(p, axis=1), axis=0) if len(p) else p
        p = p[p[:, 0] != p[:, 1]]
        more, hub_of, member = [], [], []
        for a, L in zip(at[~short].tolist(), size[~short].tolist(), strict=True):
            names = name[a : a + L]
            if split:
                hub, rank = first_of(names)
                more += [(2, (key[0].as_py() << 32) | int(token[a]), hub, rank, *x) for x in sliced(np.unique(names), lim.slice)]
            elif len(names := names[live(n[a : a + L], rest[a : a + L], num, den)]) > 1:
                hub_of.append(np.full(len(names), first_of(names)[0]))
                member.append(names)
        if member:
            h, m = np.concatenate(hub_of), np.concatenate(member)
            order = np.lexsort((m, h))
            h, m = h[order], m[order]
            new = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(m) != 0)])
            h, m = h[new], m[new]
            cut = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
            more += [(1, int(h[a]), 0, 0, *x) for a, b in zip(cut[:-1], cut[1:], strict=True) for x in sliced(m[a:b], lim.slice)]
        none = pa.nulls(len(p))
        return pa.concat_tables([
            pa.table([pa.array(np.zeros(len(p), np.int32)), pa.array(p[:, 0]), pa.array(p[:, 1]), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_FOUND_SCHEMA),
            pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*more, strict=True) if more else [()] * 6, _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA),
        ])

    return run


def _members(key, table):
    """Packed names of one slice of a hub -> its distinct members."""
    names = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("members")]))
    return pa.table({"hub": np.full(len(names), key[0].as_py(), np.int64), "name": names})


# ---- exact answers ----


def overlaps(sets: list[np.ndarray], lead: int) -> np.ndarray:
    """How many tokens each two sets share. The diagonal has no meaning.

    Overlaps with the lead come first, as masks over its tokens. Two members share the tokens of the lead that both
    masks have, plus what they share outside of it: their answers follow from the lead's.
    """
    base, N = sets[lead], len(sets)
    mask, rest = np.zeros((N, len(base)), np.float32), []
    for k, s in enumerate(sets):
        at = np.minimum(np.searchsorted(base, s), len(base) - 1)
        hit = base[at] == s
        mask[k, at[hit]] = 1
        rest.append(s[~hit])
    over = np.rint(mask @ mask.T).astype(np.int32)
    token, row = np.concatenate(rest), np.repeat(np.arange(N), [len(r) for r in rest])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], np.diff(token) > 0])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(token)))
    dense = size > max(8, N // 8)
    for a in range(0, int(dense.sum()), 1024):  # tokens of many sets: masks again
        part = np.flatnonzero(dense)[a : a + 1024]
        mask = np.zeros((N, len(part)), np.float32)
        for k, t in enumerate(part.tolist()):
            mask[row[at[t] : at[t] + size[t]], k] = 1
        over += np.rint(mask @ mask.T).astype(np.int32)
    some = np.repeat((size > 1) & ~dense, size)  # tokens of a few: pair by pair
    ends, i = np.repeat(at + size, size), np.flatnonzero(some)
    for d in range(1, int(size[(size > 1) & ~dense].max(initial=0))):
        i = i[i + d < ends[i]]
        np.add.at(over, (row[i], row[i + d]), 1)
        np.add.at(over, (row[i + d], row[i]), 1)
    return over


def joining_links(sets: list[np.ndarray], lead: int, component: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of different components that join these, as few as it takes: less than there are components."""
    size, over = np.array([len(s) for s in sets], np.int64), overlaps(sets, lead)
    ok = den * over >= num * (size[:, None] + size - over)
    names, c = np.unique(component, return_inverse=True)
    a, b = np.nonzero(ok & (c[:, None] < c))
    _, first = np.unique(c[a] * len(names) + c[b], return_index=True)
    top, out = list(range(len(names))), []

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
        if (u := find(c[x])) != (v := find(c[y])):
            top[u] = v
            out.append((x, y))
    return out


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _group_links(width, num, den):
    def run(key, table):
        """(name, text, component) of a group around the set that key begins with, or any other if that one is not in it -> the links that join components."""
        names = table.column("name").to_pylist()
        keep = {name: i for i, name in enumerate(names)}  # a text may have come twice
        table = table.take(pa.array(list(keep.values()), pa.int64()))
        names, sets = list(keep), [s for _, s in sets_of(table.column("text"), width)]
        lead = names.index(key[0].as_py()) if key[0].as_py() in keep else 0
        links = joining_links(sets, lead, table.column("component").to_numpy(), num, den)
        return pa.table({"u": pa.array([names[a] for a, _ in links], pa.int64()), "v": pa.array([names[b] for _, b in links], pa.int64())}, schema=_LINKS)

    return run


def _pair_links(width, num, den):
    def run(batches):
        """(a, b, text_a, text_b) -> links."""
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = (s for _, s in sets_of(batch.column(2), width))
            y = (s for _, s in sets_of(batch.column(3), width))
            ok = np.zeros(len(a), bool)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok[i] = den * both >= num * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], schema=_LINKS)

    return run


def _may_link(num, den):
    def run(batches):
        """(a, b, sizes, parities) -> pairs that may link."""
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k).to_pylist() for k in range(6))
            ok = pa.array([may_link(*v, num, den) for v in zip(x, y, n, m, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 5, num: int = 75, den: int = 100, lim: Limits | None = None) -> DataFrame:
    """row_id, n_shingles and component_id (the smallest id reachable by links) of each row of docs.

    Sets are the distinct shingles of width words; a shorter text's whole word sequence is one shingle. Rows link when
    den * |intersection| >= num * |union|. Null, empty and wordless texts have no shingles, link with nothing, and are
    their own component. Repeated rows link as equal texts do. A null id takes part with its text; its component is the smallest
    id that is not null, or null. Other columns play no part. An empty table gives an
    empty table.
    """
    spark, lim = docs.sparkSession, lim or Limits()
    key = F.xxhash64(row_id, text)
    kind = docs.schema[row_id].dataType.simpleString()
    scratch = []

    def kept(df, tag):
        scratch.append(store(df, tag))
        return scratch[-1]

    def sent(df, tag):
        """Rows that ask for texts, without them: to all tasks if they are few, so that the texts are not shuffled to meet them."""
        return small(kept(df, tag), lim.broadcast)

    nodes = kept(docs.select(F.col(row_id).alias("id"), key.alias("key"), text).mapInArrow(frugal(_describe(width, lim.name_bits)), f"id {kind}, key long, n long, name long, check long, bits binary"), "sets")

    def classes_of(nodes):
        named = nodes.where("name is not null").groupBy("name").agg(F.min(F.struct("key", "n", "bits")).alias("x"), F.min("id").alias("id"), F.min("check").alias("low"), F.max("check").alias("high"))
        return kept(named.select("name", "x.*", "id", "low", "high"), "classes")

    classes, clashes = classes_of(nodes), {}
    if not (twice := classes.where("low <> high").select("name")).isEmpty():
        # Of N sets about N * N / 4e19 share a name with another.
        found = nodes.join(twice, "name", "left_semi").select("name", "check").distinct().collect()
        clashes = {(r.name, r.check): int(mix(np.array([r.name ^ r.check], np.int64).view(U)).view(np.int64)[0]) for r in found}
        new = spark.createDataFrame([(*k, v) for k, v in clashes.items()], "name long, check long, new long")
        nodes = kept(nodes.join(new, ["name", "check"], "left").withColumn("name", F.coalesce("new", "name")).drop("new"), "sets")
        classes = classes_of(nodes)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    power = lambda x: max(2, int(np.ceil(np.log2(max(1, x)))))

    # Which tokens are frequent decides on order and speed, never on results.
    bits = min(30, power(total / (4 * lim.bucket)))
    cell_bits = min(bits + LOW, max(bits + 3, min(lim.cell_bits, power(total / 2))))
    frequent = docs.select(text).mapInArrow(frugal(_count_blobs(width, bits, lim.seen)), "bucket int, tokens binary").groupBy("bucket").applyInArrow(_frequent(lim.hot, cell_bits - bits), "token long, n long, cells binary, whole boolean")
    frequent = kept(frequent.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "frequent")
    # Those dealt into parts are always known: at most total / (2 * hot_part), whatever max_hot.
    hot_part = max(lim.hot_part, total >> 21)
    least, n, heavy = 0, 0, int(8 * np.log2(2 * hot_part))
    for r in frequent.where("cells is null").groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        n += r.n
        if n > lim.max_hot:
            least = min(r.level + 1, heavy)
            break
    hot = frequent.where(F.col("level") >= least).select("token", "n").toArrow()
    order = np.argsort(hot.column("token").to_numpy())
    cells = np.zeros((1 << bits, 1 << cell_bits - bits - 3), np.uint8)
    whole = True
    for r in frequent.where("cells is not null").select("token", "cells", "whole").toLocalIterator():
        cells[r.token], whole = np.frombuffer(r.cells, np.uint8), whole and r.whole
    shared = spark.sparkContext.broadcast((hot.column("token").to_numpy()[order], hot.column("n").to_numpy()[order], cells.ravel()))

    hot_bits, bits = bits, min(30, power(total * (den - num) / den / lim.bucket))
    post = docs.select(text).mapInArrow(frugal(_postings(width, hot_bits, bits, shared, cell_bits, whole, num, den, hot_part, namer(lim.name_bits, clashes), lim.seen)), "bucket int, part int, token binary, name binary, n binary, rest binary")
    found = kept(post.groupBy("bucket", "part").applyInArrow(_lists(num, den, lim), _FOUND), "found")

    def side(c):
        return classes.select(F.col("name").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    pairs = found.where("kind = 0").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    pairs = kept(pairs.mapInArrow(frugal(_may_link(num, den)), "a long, b long"), "pairs")

    # Split lists take the first of all their parts' sets as hub.
    parts = found.where("kind = 2")
    first = parts.groupBy("a").agg(F.min_by("b", "rank").alias("hub"))
    packed = found.where("kind = 1").select(F.col("a").alias("hub"), "slice", "members").union(parts.join(first, "a").select("hub", "slice", "members"))
    hubs = kept(packed.groupBy("hub", "slice").applyInArrow(_members, "hub long, name long").distinct(), "hubs")

    # Groups around the set that most candidates of a set are candidates of.
    near = hubs.where("name <> hub").select(F.col("name").alias("a"), F.col("hub").alias("b"))
    both = pairs.union(pairs.select("b", "a")).union(near).union(near.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("degree"))
    near = both.join(degree.withColumnsRenamed({"a": "b"}), "b").select("a", F.struct("degree", "b").alias("x"))
    lead = near.union(degree.select("a", F.struct("degree", F.col("a").alias("b")).alias("x"))).groupBy("a").agg(F.max("x").alias("x")).select(F.col("a").alias("name"), F.col("x.b").alias("lead"))
    lead = kept(lead.join(classes.select("name", "key", "n"), "name"), "leads")
    salts = F.ceil(F.greatest(F.count("*") / lim.group, F.sum("n") / lim.group_tokens)).cast("int")
    member = lead.join(lead.groupBy("lead").agg(salts.alias("salts")), "lead").select("name", "key", "lead", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int").alias("salt"), "salts")
    member = kept(member, "members")
    texts = docs.select(key.alias("key"), F.col(text).alias("text")).join(small(member.select("name", "key"), lim.broadcast), "key").select("name", "text").dropDuplicates(["name"])
    texts = kept(texts, "texts")
    leads = member.where("name = lead").select("name", "lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = member.where("name <> lead").select("name", "lead", "salt")
    absent = others.join(leads.select("lead"), "lead", "left_anti").select(F.col("lead").alias("name"), "lead", "salt").distinct()
    rows = texts.join(sent(others.union(leads).union(absent), "groups"), "name").withColumn("component", F.col("name"))
    links = kept(rows.groupBy("lead", "salt").applyInArrow(_group_links(width, num, den), "u long, v long"), "links")
    components = connected_components(links)

    def label(df, c, out):
        return df.join(components.select(F.col("node").alias(c), F.col("component").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))

    def joined(links):
        """The components with more links, found from those at hand."""
        return components if links.isEmpty() else connected_components(links.union(components.select("node", "component")))

    # Pairs that are left: between groups, and not in one component yet.
    where = member.select("name", F.struct("lead", "salt").alias("group"))
    rest = label(label(pairs, "a", "ca"), "b", "cb").where("ca <> cb")
    rest = rest.join(where.select(F.col("name").alias("a"), F.col("group").alias("ga")), "a").join(where.select(F.col("name").alias("b"), F.col("group").alias("gb")), "b").where("ga <> gb").select("a", "b")
    rest = texts.select(F.col("name").alias("a"), F.col("text").alias("text_a")).join(sent(rest, "rest"), "a").join(texts.select(F.col("name").alias("b"), F.col("text").alias("text_b")), "b")
    components = joined(kept(rest.select("a", "b", "text_a", "text_b").mapInArrow(frugal(_pair_links(width, num, den)), "u long, v long"), "links"))

    # Hubs whose members are in several components: blocks outside of the largest one meet all blocks of sizes in reach.
    spread = label(hubs, "name", "component")
    tops = spread.groupBy("hub", "component").agg(F.count("*").alias("m")).groupBy("hub").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    # Sizes that can link are at most one band apart.
    band = F.floor(F.log("n") / float(np.log(max(den / num, 1.1) * 1.01))).cast("long")
    work = spread.join(tops.select("hub", F.col("top.component").alias("main")), "hub").join(classes.select("name", "n"), "name")
    work = kept(work.select("hub", "name", "component", "n", band.alias("band"), (F.col("component") != F.col("main")).cast("long").alias("out")), "work")
    if not work.isEmpty():
        count = F.ceil(F.greatest(F.count("*") / lim.grid, F.sum("n") / lim.grid_tokens)).cast("long")
        sizes = kept(work.groupBy("hub", "out", "band").agg(count.alias("count")), "sizes")
        block = F.shiftleft("band", 33) + F.col("sub") * 2 + F.col("out")
        blocks = sizes.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).select("hub", "out", "band", block.alias("block"))
        x, y = blocks.where("out = 1").select("hub", F.col("band").alias("xb"), F.col("block").alias("x")), blocks.select("hub", F.col("out").alias("yo"), F.col("band").alias("yb"), F.col("block").alias("y"))
        meets = x.join(y, "hub").where("abs(xb - yb) <= 1 and (yo = 0 or x <= y)").select("hub", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
        work = work.join(sizes, ["hub", "out", "band"]).withColumn("sub", F.pmod(F.xxhash64("name"), F.col("count"))).withColumn("block", block)
        rows = texts.join(sent(work.select("hub", "block", "name", "component").join(meets, ["hub", "block"]), "meets"), "name")
        more = rows.select("hub", "x", "y", "name", "text", "component").groupBy("hub", "x", "y").applyInArrow(_group_links(width, num, den), "u long, v long")
        components = joined(kept(more, "links"))

    grouped = label(classes.select("name", "id"), "name", "component")
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    named = grouped.join(least, "component").select("name", "component_id")
    out = nodes.join(named, "name", "left").select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = store(out, "components")
    for df in scratch:
        drop_stored(df)
    return out
