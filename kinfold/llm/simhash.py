"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments, each a word of the perfect binary Golay code (23, 12, 7), padded with zeros.
A word decodes to the one codeword within three bits; if that is three bits away, five more codewords are four bits away.
These one or six indices are its keys: two words at most two bits apart always share one (`golay_keys`, tested for all
error patterns). Of at most four differing bits some two segments hold at most two (pigeonhole), so two linked
fingerprints share a key in both segments of some pair: a cell. Fingerprints go to the cells' blocks, meet there, and
every link is verified by its bits. Blocks give back forests, not pairs: within one the links of a cell are reduced to
components, and around a leader all fingerprints at most half the distance away are linked without being compared.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, drop_stored, small, store
from .textbytes import frugal

U = np.uint64
#: The generator polynomial of the Golay code, and its lengths.
GENERATOR, LENGTH, INFO = 0xC75, 23, 12
CHECK = LENGTH - INFO
#: Start and width of each segment of the fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
MOST_BITS, SEED = 4, 42
#: Entries of a block aimed at, entries beyond which a block is split into parts, fingerprints that a task packs at once, rows that are broadcast.
BLOCK, PART, CHUNK, MOST_BROADCAST = 1 << 17, 1 << 20, 1 << 17, 1 << 20
#: Members of a cell that are compared by shifts; larger cells go by leaders.
SMALL_CELL = 48
_WINDOW = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


# ---- fingerprints ----


def _parts(data: bytes):
    """The words of data, in lists: a very long text is split at white space."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + _WINDOW)
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is set if it is in over half of the XXH64 of the text's shingles of width words, repeats included."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    h = xxhash.xxh64_intdigest

    def add(hashes):
        nonlocal counts, n
        for k in range(0, len(hashes), 1 << 13):
            x = np.array(hashes[k : k + (1 << 13)], "<u8")
            counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)

    for words in _parts((text or "").encode().lower()):  # bytes: only A-Z are lower-cased, only ASCII space splits
        words = tail + words
        if len(words) >= width:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(size)
            starts = ends - size
            add([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)])
            words = words[len(words) - width + 1 :]
        tail = words
    if not n and tail:
        add([h(b" ".join(tail), SEED)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 4) -> DataFrame:
    """id and f (the fingerprint's bits as a long) of each row."""

    def run(batches):
        for batch in batches:
            f = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], names=["id", "f"])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), text).mapInArrow(frugal(run), f"id {kind}, f long")


# ---- the code ----

_TABLES: dict[str, np.ndarray] = {}


def _rest(x: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial."""
    x = x.copy()
    for i in range(LENGTH - 1, CHECK - 1, -1):
        x = np.where(x >> i & 1, x ^ (GENERATOR << (i - CHECK)), x)
    return x


def _tables() -> dict[str, np.ndarray]:
    """By syndrome: the error pattern of at most three bits, and what turns a codeword's index into those four bits away (-1: none)."""
    if not _TABLES:
        info = np.arange(1 << INFO) << CHECK
        codewords = info | _rest(info)
        one = 1 << np.arange(LENGTH)
        two = (one[:, None] | one)[np.triu_indices(LENGTH, 1)]
        three = np.unique([a | b for a in two for b in one if not a & b])
        errors = np.concatenate([[0], one, two, three])
        by_syndrome = np.zeros(1 << CHECK, np.int64)
        by_syndrome[_rest(errors)] = errors
        others = np.full((1 << CHECK, 5), -1)
        seven = codewords[np.bitwise_count(codewords) == 7]
        for e in three:
            others[_rest(np.array([e]))[0]] = seven[seven & e == e] >> CHECK
        _TABLES.update(error=by_syndrome, others=others, low=np.arange(1 << CHECK), high=_rest(info))
    return _TABLES


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): the indices of the codewords within three bits of each word and, if that is three bits away, of the five that are four bits away; -1 where there are none."""
    t = _tables()
    words = words.astype(np.int64)
    syndrome = t["low"][words & ((1 << CHECK) - 1)] ^ t["high"][words >> CHECK]
    nearest = (words ^ t["error"][syndrome]) >> CHECK
    others = t["others"][syndrome]
    return np.column_stack([nearest, np.where(others < 0, -1, others ^ nearest[:, None])])


def cells(f: np.ndarray, pair: int) -> np.ndarray:
    """(n, 36): the cells of fingerprints by one pair of segments, 24 bits each, -1 where there are fewer."""
    a, b = (golay_keys(f >> U(s) & U((1 << w) - 1)) for s, w in (SEGMENTS[k] for k in PAIRS[pair]))
    both = (a[:, :, None] << INFO) | b[:, None, :]
    return np.where((a[:, :, None] < 0) | (b[:, None, :] < 0), -1, both).reshape(len(f), 36)


# ---- links within a block ----


class Forest:
    """Components of numbers below n; the root of each is its least."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _near(f: np.ndarray, g) -> np.ndarray:
    return np.bitwise_count(f ^ g)


def link_cell(f: np.ndarray, at: np.ndarray, forest: Forest, most: int = MOST_BITS) -> None:
    """Joins the components of the fingerprints f[at], whose links are at most `most` bits.

    Each takes the first leader within half of that, or leads itself: what is around one leader is linked. Leaders meet
    each other; around a leader of several, all within most more bits meet its own. No link is lost: one between two
    lone leaders is found by the leaders, any other by the leader of an end.
    """
    half, rest, leaders, balls = most // 2, at, [], []
    while len(rest):
        close = _near(f[rest], f[rest[0]]) <= half
        leaders.append(rest[0])
        balls.append(rest[close])
        rest = rest[~close]
    lead = np.array(leaders)
    forest.join(np.concatenate(balls), np.repeat(lead, [len(b) for b in balls]))
    for k in range(len(lead) - 1):
        other = lead[k + 1 :]
        other = other[_near(f[other], f[lead[k]]) <= most]
        forest.join(other, np.full(len(other), lead[k]))
    for leader, ball in zip(lead, balls, strict=True):
        if len(ball) > 1:
            out = at[(forest.root[at] != forest.root[leader]) & (_near(f[at], f[leader]) <= most + half)]
            for k in range(0, len(out), 4096):
                i, j = np.nonzero(_near(f[out[k : k + 4096], None], f[ball]) <= most)
                forest.join(out[k + i], ball[j])


def block_links(f: np.ndarray, pair: int, shift: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (fingerprint, the least of its component) of distinct fingerprints that meet in the cells of one block."""
    forest, found = Forest(len(f)), []
    for k in range(0, len(f), 1 << 15):
        c = cells(f[k : k + (1 << 15)], pair)
        i, j = np.nonzero((c >= 0) & (c >> shift == block))
        found.append(np.column_stack([c[i, j], i + k]))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    cell, at = found[:, 0], found[:, 1]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(start, len(cell)))
    for s, n in zip(start[size > SMALL_CELL].tolist(), size[size > SMALL_CELL].tolist(), strict=True):
        link_cell(f, at[s : s + n], forest)
    keep = np.repeat((size <= SMALL_CELL) & (size > 1), size)
    cell, at = cell[keep], at[keep]
    for k in range(1, min(SMALL_CELL, len(at))):
        same = np.flatnonzero(cell[k:] == cell[:-k])
        if not len(same):
            break
        same = same[_near(f[at[same]], f[at[same + k]]) <= MOST_BITS]
        forest.join(at[same], at[same + k])
    linked = np.flatnonzero(forest.root != np.arange(len(f)))
    return f[linked], f[forest.root[linked]]


# ---- tasks ----


def _deal(shift: int):
    """(f) -> fingerprints packed by pair and block, in which they have a cell."""

    def rows(f):
        f = np.unique(f)
        out = []
        for pair in range(len(PAIRS)):
            dealt = []
            for k in range(0, len(f), 1 << 14):
                c = cells(f[k : k + (1 << 14)], pair)
                c = np.sort(np.where(c < 0, -1, c >> shift), axis=1)
                i, j = np.nonzero((c >= 0) & np.column_stack([np.ones(len(c), bool), c[:, 1:] != c[:, :-1]]))
                dealt.append(np.column_stack([c[i, j], i + k]))
            dealt = np.concatenate(dealt)
            dealt = dealt[np.argsort(dealt[:, 0], kind="stable")]
            start = np.flatnonzero(np.concatenate([[True], dealt[1:, 0] != dealt[:-1, 0]]))
            for a, b in zip(start, np.append(start[1:], len(dealt)), strict=True):
                out.append((pair, int(dealt[a, 0]), int(b - a), f[dealt[a:b, 1]].tobytes()))
        pairs, blocks, n, packed = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(blocks, pa.int32()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["pair", "block", "n", "packed"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(U))
            n += len(held[-1])
            if n >= CHUNK:
                yield rows(np.concatenate(held))
                held, n = [], 0
        if n:
            yield rows(np.concatenate(held))

    return run


def _link(shift: int):
    def run(key, table):
        f = np.unique(np.frombuffer(b"".join(table.column("packed").to_pylist()), U))
        u, v = block_links(f, key[0].as_py(), shift, key[1].as_py())
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def simhash_components(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 4) -> DataFrame:
    """row_id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable by links of at most four differing bits.

    Words are lower-cased by A-Z and split at ASCII white space. A text of fewer than width words is one shingle; null,
    empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows link as equal texts do.
    A null id takes part with its text; its component is the smallest id that is not null, or null. Other columns play
    no part. An empty table gives an empty table.

    Equal fingerprints are one before anything is joined, so copies of a text cost nothing. A block of cells that still
    holds over PART fingerprints is split into parts that meet by twos, in tasks of their own.
    """
    nodes = store(fingerprints(docs, text, row_id, width), "prints")
    classes = store(nodes.groupBy("f").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    # About 5.3 * 5.3 cells of each pair hold a fingerprint; blocks are ranges of cells.
    bits = int(np.clip(np.ceil(np.log2(max(1.0, classes.count() * 6 / BLOCK))), 0, 2 * INFO))
    shift = 2 * INFO - bits
    dealt = store(classes.select("f").mapInArrow(frugal(_deal(shift)), "pair int, block int, n long, packed binary"), "dealt")
    parts = F.ceil(F.sum("n") / PART).cast("int")
    sizes = dealt.groupBy("pair", "block").agg(F.when(parts > 1, 2 * parts).otherwise(1).alias("parts"))  # at most a row for each range of cells
    part = F.pmod(F.xxhash64("packed"), F.col("parts")).cast("int")
    own = dealt.join(small(sizes, MOST_BROADCAST), ["pair", "block"]).withColumn("part", part)
    meets = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")),
            lambda x: F.struct(F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j")),
        )
    )
    met = own.select("pair", "block", F.explode(meets).alias("meet"), "packed")
    links = store(met.groupBy("pair", "block", "meet").applyInArrow(_link(shift), "u long, v long").distinct(), "links")
    linked = connected_components(links).select(F.col("node").alias("f"), "component")
    # Only fingerprints with a link, or of several rows, need another row's id.
    least = linked.join(classes, "f").groupBy("component").agg(F.min("id").alias("least"))
    named = linked.join(least, "component").select("f", F.col("least").alias("least"))
    alone = classes.where("copies > 1").join(linked.select("f"), "f", "left_anti").select("f", F.col("id").alias("least"))
    named = store(named.union(alone).withColumn("known", F.lit(True)), "named")
    out = nodes.join(small(named, MOST_BROADCAST), "f", "left")
    out = out.select(F.col("id").alias(row_id), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.when(F.col("known"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    out = store(out, "components")
    for df in (nodes, classes, dealt, links, named):
        drop_stored(df)
    return out
