"""Alignment of two tokenizers over a corpus, by id-striped dense count matrices.

Both tokenizers cut the same bytes. Byte offsets at which both end a token cut the tokens into groups; each stretch
between neighbouring ends of either is a link of one A token and one B token. How often two ids are linked decides how
well they fit. B ids are dealt into stripes. A task that reads texts packs its links by stripe, equal ones of a text
once with their number; a stripe's links meet in a dense block of counts (B ids of the stripe x A ids), whose row maxima
are the best. Links are scored in the stripe's own tasks, where its block is; back go sums by document alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder
from .shared import drop_stored, store
from .textbytes import frugal
from .token_counts import MARK, Encoder

#: B ids of a stripe (at most 256); links that are packed at once; documents of a chunk (at most 65,536); bytes that are aligned at once.
STRIPE, LINKS, DOCS, SPAN = 128, 1 << 21, 1 << 15, 1 << 20
#: Packed rows of a stripe that one task adds up, and links that one task scores.
SALT_ROWS, SALT_LINKS = 1 << 12, 1 << 20
_A_BITS = _DOC_BITS = 20
_PAIRS: dict[tuple[str, str], Pair] = {}


class Pair:
    """Two tokenizers: A, a byte-level BPE that reads a space before each text; B, a SentencePiece model that puts it there itself."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = encoder(a_file), Encoder.of(b_file)
        sp = self.b.sp
        by_id = {i: t for t, i in self.a._mergeable_ranks.items()} | {i: t.encode() for t, i in self.a._special_tokens.items()}
        self.a_bytes = [by_id.get(i, b"") for i in range(self.a.n_vocab)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.vocab_size())))]
        self.a_table, self.b_table = (np.array([*x, None], object)[:-1] for x in (self.a_bytes, self.b_bytes))
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # What a token adds to the text of groups: its number and what follows it.
        self.names = np.array([f"{i}{end}".encode() for size, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(size) for end in ends], object)

    @classmethod
    def of(cls, a_file: str, b_file: str) -> Pair:
        if (a_file, b_file) not in _PAIRS:
            _PAIRS[a_file, b_file] = cls(a_file, b_file)
        return _PAIRS[a_file, b_file]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B; none if the text is empty or either's bytes are not a space and the text's."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        b = self.b.encode(text).astype(np.int64)
        want = b" " + text.encode()
        same = all(b"".join(x[ids].tolist()) == want for x, ids in ((self.a_table, a), (self.b_table, b)))
        return (a, b) if same else (none, none)


class Digest:
    """The digest of a text's groups, span by span; '' without tokens."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, part: bytes) -> None:
        if part:
            self.sha.update(b";" * self.any + part[:-1])
            self.any = True

    def text(self) -> str:
        return self.sha.hexdigest() if self.any else ""


def spans(mark: np.ndarray, span: int):
    """Ranges (from, to] of ends, each up to a common one, of about span bytes."""
    low = 0
    while low < len(mark) - 1:
        high = min(low + span, len(mark) - 1)
        common = np.flatnonzero(mark[low + 1 : high + 1] == 3)
        while not len(common):
            low_, high = high, min(high + span, len(mark) - 1)
            common = np.flatnonzero(mark[low_ + 1 : high + 1] == 3) + low_ - low
        end = low + 1 + int(common[-1])
        yield low, end
        low = end


def align(pair: Pair, docs: list[tuple[np.ndarray, np.ndarray]], span: int = SPAN):
    """For each span of the texts' tokens: document, A id and B id of each link, documents' groups, and the parts of their digests."""
    a, b = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    ea, eb = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    if not len(a):
        return
    ends = np.cumsum([int(pair.a_size[d[0]].sum()) for d in docs])
    mark = np.zeros(int(ends[-1]) + 1, np.uint8)
    mark[ea] = 1
    mark[eb] += 2
    at_a = at_b = 0
    b_names = 2 * len(pair.a_bytes)
    for low, high in spans(mark, span):
        end = np.flatnonzero(mark[low + 1 : high + 1]) + low + 1
        kind = mark[end]
        of_a, of_b, both = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64), kind == 3
        ia, ib = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        sa, sb = a[at_a : at_a + int(of_a.sum())], b[at_b : at_b + int(of_b.sum())]
        at_a, at_b = at_a + len(sa), at_b + len(sb)
        group = np.cumsum(both) - both
        doc = np.searchsorted(ends, end)
        ga, gb = group[of_a > 0], group[of_b > 0]
        n = int(both.sum())
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        order = np.empty(len(sa) + len(sb), np.int64)
        order[np.arange(len(sa)) + (np.cumsum(nb) - nb)[ga]] = 2 * sa + last_a
        order[np.arange(len(sb)) + np.cumsum(na)[gb]] = b_names + 2 * sb + last_b
        names = pair.names[order].tolist()
        in_doc = doc[both]
        first = np.flatnonzero(np.append(True, in_doc[1:] != in_doc[:-1]))
        cuts = [0, *np.cumsum(np.add.reduceat(na + nb, first)).tolist()]
        yield doc, sa[ia], sb[ib], np.bincount(in_doc, minlength=len(docs)), [(int(in_doc[f]), b"".join(names[x:y])) for f, x, y in zip(first, cuts[:-1], cuts[1:], strict=True)]


_LINK_COLS = ("a", "b", "runs", "total", "docs", "times")
_TYPES = {"a": "<u4", "b": "u1", "runs": "<u4", "total": "<u4", "docs": "<u2", "times": "u1"}


def pack_links(keys: np.ndarray, a_type: str):
    """Rows (stripe, links, a, b, runs, total, docs, times) of links given as b, a, document in one number.

    By pair of ids: how many entries it has and what they sum to. By entry: document, and how often it has the pair; 255 at most, more take more entries.
    """
    key, times = np.unique(keys, return_counts=True)
    more = (times + 254) // 255
    if (more > 1).any():
        last = np.cumsum(more) - 1
        left = times - 255 * (more - 1)
        key, times = np.repeat(key, more), np.full(int(more.sum()), 255)
        times[last] = left
    pair = key >> _DOC_BITS
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    a, b = pair[start] & ((1 << _A_BITS) - 1), pair[start] >> _A_BITS
    runs, total = np.diff(np.append(start, len(key))), np.add.reduceat(times, start)
    docs = key & ((1 << _DOC_BITS) - 1)
    stripe = b // STRIPE
    cut = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1]))
    for x, y in zip(cut, np.append(cut[1:], len(stripe)), strict=True):
        i, j = start[x], start[y] if y < len(start) else len(key)
        cols = (a[x:y].astype(a_type), (b[x:y] % STRIPE).astype("u1"), runs[x:y].astype("<u4"), total[x:y].astype("<u4"), docs[i:j].astype("<u2"), times[i:j].astype("u1"))
        yield int(stripe[x]), int(total[x:y].sum()), *(c.tobytes() for c in cols)


def _encode(a_file: str, b_file: str, kind: pa.DataType):
    """(id, text) -> documents' rows, and links' rows by chunk and stripe."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc", pa.int32()), ("id", kind), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("sha", pa.string()), ("stripe", pa.int32()), ("links", pa.int64())]
        + [(c, pa.binary()) for c in _LINK_COLS]
    )

    def batch_of(rows: dict[str, list]):
        n = len(next(iter(rows.values())))
        return pa.RecordBatch.from_arrays([rows[f.name] if isinstance(rows.get(f.name), pa.Array) else pa.array(rows.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def run(batches):
        pair = Pair.of(a_file, b_file)
        a_type = "<u2" if len(pair.a_bytes) <= 1 << 16 else "<u4"
        chunk, keys, n_keys, n_docs, chunk_links = TaskContext.get().partitionId() << 32, [], 0, 0, 0

        def flush():
            nonlocal keys, n_keys
            if n_keys:
                rows = list(pack_links(np.concatenate(keys), a_type))
                keys, n_keys = [], 0
                yield batch_of({"chunk": [chunk] * len(rows), **dict(zip(("stripe", "links", *_LINK_COLS), map(list, zip(*rows, strict=True)), strict=True))})

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            i = 0
            while i < len(texts):
                tokens, size, first = [], 0, i
                while i < len(texts) and size < SPAN and len(tokens) < 4096:
                    tokens.append(pair.tokens(texts[i].as_py()))
                    size += 4 * (len(tokens[-1][0]) + len(tokens[-1][1]))
                    i += 1
                if n_docs + len(tokens) > DOCS or chunk_links >= LINKS:
                    yield from flush()
                    chunk, n_docs, chunk_links = chunk + 1, 0, 0
                n_groups, n_links, digests = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64), [Digest() for _ in tokens]
                for doc, la, lb, groups, parts in align(pair, tokens):
                    keys.append((lb << _A_BITS | la) << _DOC_BITS | doc + n_docs)
                    n_keys += len(doc)
                    chunk_links += len(doc)
                    n_groups += groups
                    n_links += np.bincount(doc, minlength=len(tokens))
                    for d, part in parts:
                        digests[d].add(part)
                    if n_keys >= LINKS:
                        yield from flush()
                n = len(tokens)
                yield batch_of({"chunk": [chunk] * n, "doc": list(range(n_docs, n_docs + n)), "id": ids.slice(first, n), "n_a": [len(a) for a, _ in tokens], "n_b": [len(b) for _, b in tokens], "n_groups": n_groups.tolist(), "n_links": n_links.tolist(), "sha": [d.text() for d in digests]})
                n_docs += n
        yield from flush()

    return run


def _arrays(batch: pa.RecordBatch, i: int, types: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(batch.column(batch.schema.names.index(c))[i].as_py(), t) for c, t in types.items()}


def _count(width: int, types: dict[str, str]):
    """Sorted by stripe: rows (stripe, a, b, total) -> the block's cells that are not zero, one row a stripe."""
    out = pa.schema([("stripe", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "total"))])

    def run(batches):
        last, block = None, None

        def cells():
            if last is not None:
                b, a = np.nonzero(block)
                return [pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (a.astype(types["a"]), b.astype("u1"), block[b, a].astype("<i8")))], schema=out)]
            return []

        for batch in batches:
            for i, stripe in enumerate(batch.column(batch.schema.names.index("stripe")).to_pylist()):
                if stripe != last:
                    yield from cells()
                    last = stripe
                    block = np.zeros((STRIPE, width), np.int64) if block is None else block
                    block[:] = 0
                x = _arrays(batch, i, {c: types[c] for c in ("a", "b", "total")})
                np.add.at(block, (x["b"], x["a"]), x["total"].astype(np.int64))
        yield from cells()

    return run


def _score(width: int, types: dict[str, str]):
    """Sorted by stripe and salt, its counts first and then its links -> by row of links its documents' sums."""
    out = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("docs", "best", "sums"))])
    counted = {"a": types["a"], "b": "u1", "total": "<i8"}

    def run(batches):
        block = np.zeros((STRIPE, width), np.int64)
        last, most = None, None
        for batch in batches:
            chunks, stripes = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("chunk", "stripe"))
            rows = []
            for i, (chunk, stripe) in enumerate(zip(chunks, stripes, strict=True)):
                if chunk is None:
                    if stripe != last:  # the same one again if two salts of a stripe meet here
                        x = _arrays(batch, i, counted)
                        block[:] = 0
                        block[x["b"], x["a"]] = x["total"]
                        last, most = stripe, block.max(1)
                    continue
                assert stripe == last, "every link was counted, so every stripe has a block"
                x = _arrays(batch, i, {c: types[c] for c in ("a", "b", "runs", "docs", "times")})
                count = block[x["b"], x["a"]]
                best = np.repeat(count == most[x["b"]], x["runs"])
                docs, at = np.unique(x["docs"], return_inverse=True)
                n_best, sums, times = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), x["times"].astype(np.int64)
                np.add.at(n_best, at[best], times[best])
                np.add.at(sums, at, times * np.repeat(count, x["runs"]))
                rows.append((chunk, docs.tobytes(), n_best.tobytes(), sums.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def _gather(key, docs, sums):
    """A chunk's documents with their sums."""
    best, total = np.zeros(DOCS + 4096, np.int64), np.zeros(DOCS + 4096, np.int64)
    for r in zip(*(sums.column(c).to_pylist() for c in ("docs", "best", "sums")), strict=True):
        at = np.frombuffer(r[0], "<u2").astype(np.int64)
        best[at] += np.frombuffer(r[1], np.int64)
        total[at] += np.frombuffer(r[2], np.int64)
    at = docs.column("doc").to_numpy()
    return docs.drop_columns(["chunk", "doc"]).append_column("n_best", pa.array(best[at])).append_column("count_sum", pa.array(total[at]))


def align_tokens(docs: DataFrame, a_file: str, b_file: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """row_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    A (a tokenizers .json, byte-level BPE) encodes a space and the text, B (a SentencePiece model) the text. n_best counts
    a text's links whose id pair is linked most often in all docs for its B id, ties included; count_sum adds the counts of
    all its links. Null and empty texts, and those that either tokenizer does not give back byte by byte, have no
    tokens: zeros and ''. Repeated rows count each; ids may be null; other columns play no part. An empty table gives an
    empty table. Texts are aligned in spans, so what is held at once is bounded but for one text's ids.
    """
    width = encoder(a_file).n_vocab
    types = _TYPES | {"a": "<u2" if width <= 1 << 16 else "<u4"}
    src = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[row_id].dataType.simpleString()
    counts_of = "n_a long, n_b long, n_groups long, n_links long"
    made = "chunk long, doc int, id {}, {}, sha string, stripe int, links long, {}".format(kind, counts_of, ", ".join(f"{c} binary" for c in _LINK_COLS))
    from pyspark.sql.pandas.types import to_arrow_type

    encoded = store(src.mapInArrow(frugal(_encode(a_file, b_file, to_arrow_type(docs.schema[row_id].dataType))), made), "aligned")
    links = encoded.where("stripe is not null")
    # One row a stripe: as many as B has ids, over STRIPE.
    by_stripe = links.groupBy("stripe").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("adders"), F.ceil(F.sum("links") / SALT_LINKS).cast("int").alias("salts"))
    by_stripe = F.broadcast(store(by_stripe, "stripes"))
    salted = links.join(by_stripe, "stripe")
    salt = lambda n: F.pmod(F.xxhash64("chunk", "docs"), F.col(n)).cast("int")
    cells = "stripe int, a binary, b binary, total binary"
    adders = salted.withColumn("salt", salt("adders")).select("stripe", "salt", "a", "b", "total").repartition("stripe", "salt").sortWithinPartitions("stripe").drop("salt")
    some = adders.mapInArrow(frugal(_count(width, types)), cells)
    # A block is much work on few bytes, so tasks are not to be merged by size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = some.repartition(tasks, "stripe").sortWithinPartitions("stripe").mapInArrow(frugal(_count(width, types | {"total": "<i8"})), cells)
    counts = store(counts, "counts")
    copies = counts.join(by_stripe, "stripe").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("stripe", "salt", "a", "b", "total")
    asked = salted.withColumn("salt", salt("salts")).select("chunk", "stripe", "salt", "a", "b", "runs", "docs", "times")
    met = copies.unionByName(asked, allowMissingColumns=True).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("chunk").isNotNull())
    sums = met.mapInArrow(frugal(_score(width, types)), "chunk long, docs binary, best binary, sums binary")
    rows = encoded.where("doc is not null").select("chunk", "doc", "id", "n_a", "n_b", "n_groups", "n_links", "sha")
    out = rows.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_gather, f"id {kind}, {counts_of}, sha string, n_best long, count_sum long")
    out = store(out.select(F.col("id").alias(row_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256")), "scored")
    for df in (encoded, counts):
        drop_stored(df)
    return out
