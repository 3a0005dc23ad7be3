"""Whitening, SimHash and cross-tokenizer alignment against brute force."""

import hashlib
import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from test_operators import SCHEMA, SF, TEXTS, words

from tokenizers import Tokenizer

from kinfold.llm import alignment, language_id, line_dedup, packing, queries, simhash, topk_search, whitening

# ---- whitening ----


def brute_whitening(rows, k=16):
    """Columns by vec_id, from eigenvectors of the covariance."""
    kept = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(0)
    y = (fit * n - s) / n
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    out = []
    for i, x in kept:
        dev = int(((n * x - s).astype(object) ** 2).sum())
        w = ((n * x - s) / n) @ vec[:, order] / np.sqrt(e[order])
        out += [(i, c + 1, n, dev, w[c], e[order[c]] / np.trace(cov)) for c in range(len(order))]
    return out


def same_whitening(got, want):
    assert len(got) == len(want)
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got), key=lambda r: (r[1], r[3], repr(r[0])))
    want = sorted(want, key=lambda r: (r[1], r[3], repr(r[0])))
    for c, pairs in itertools.groupby(zip(got, want, strict=True), key=lambda p: p[0][1]):
        a, b = (np.array([p[k][4] for p in pairs_]) for k, pairs_ in enumerate(itertools.tee(list(pairs), 2)))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6, c  # either sign, one for all rows
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[5] == pytest.approx(b[5], rel=1e-8)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.QUERIES["op11_whitening"](spark, SF).collect()
    same_whitening(got, brute_whitening([tuple(r) for r in df.select("vec_id", "embedding").collect()]))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5)) @ np.diag([30, 3, 1, 0.5, 0.1])
    rows = [(i, v[i % 50].tolist()) for i in range(60)] + [(None, v[3].tolist()), (61, None), (62, [None] * 5), (63, [float("nan")] * 5), (64, [float("inf")] * 5), (65, [])]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, whitened string, n int").repartition(5)
    got = whitening.whiten(df, k=3)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same_whitening(got.collect(), brute_whitening([r for r in rows if r[0] != 65], 3))
    # Vectors of another length are a space of their own; huge entries keep their place.
    more = spark.createDataFrame([(100 + i, [1e300 if i == 0 else float(i), 2.0 * i, float(i * i % 7)]) for i in range(6)], "vec_id long, embedding array<double>")
    both = whitening.whiten(df.select("vec_id", "embedding").union(more), k=3).collect()
    same_whitening([r for r in both if r.vec_id is None or r.vec_id < 100], brute_whitening([r for r in rows if r[0] != 65], 3))
    # (6 * 2 ** 52) ** 2 is no long
    assert {r.n for r in both if r.vec_id and r.vec_id >= 100} == {6} and all(r.deviation is None for r in both if r.vec_id == 100)
    assert all(np.isfinite(r.whitened) for r in both)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.explained, abs(round(r.whitened, 12))) for r in got] == [(1, 2, 1.0, 1.0)] * 3


def test_triangles_of_many_tasks_and_small_deviations(spark, monkeypatch):
    """A tree of several levels; a deviation of 1e-7 of the largest keeps its digits, which a covariance would lose."""
    monkeypatch.setattr(whitening, "FAN", 2)
    stacked = []
    rng = np.random.default_rng(5)
    x = np.rint(rng.normal(size=(400, 3)) * [1e9, 1e5, 30]).astype(np.int64)
    df = spark.createDataFrame([(i, (r / 64).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "store", lambda df, tag, f=whitening.store: f(df.repartition(7) if tag == "fit" else df, tag).transform(lambda x: stacked.append((tag, x.rdd.getNumPartitions())) or x))
    models = whitening.fit(df, k=3)
    assert dict(stacked)["fit"] > 2, "several triangles"
    y = x - x.mean(0)
    want = np.linalg.svd(y / 1.0)[1] / 20
    assert models[3].sigma == pytest.approx(want, rel=1e-7) and models[3].identity_error < 1e-4
    u, s = whitening.jacobi(rng.normal(size=(9, 9))), None
    assert np.abs(u[1].T @ u[1] - np.eye(9)).max() < 1e-13 and s is None


def test_packed_vectors():
    x = np.array([[127, -128], [128, 0], [-129, 5], [1 << 15, 0], [-(1 << 31), 0], [1 << 31, 0], [3, 3]]) + 7
    rows = whitening.pack(x, 7)
    assert [len(r) // 2 for r in rows] == [1, 2, 2, 4, 4, 8, 1]
    import pyarrow as pa

    back = {tuple(r) for _, y in whitening.unpack(pa.array(rows, pa.binary()), np.full(len(x), 2), 7) for r in y.tolist()}
    assert back == {tuple(r) for r in x.tolist()}


# ---- simhash ----


def brute_fingerprint(text):
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_links(prints):
    """Least id of each row's component. prints: (id, fingerprint)."""
    f = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[: i + 1] ^ f[i]) <= 4).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, f"{p:016x}", least.get(find(i))) for i, (k, p) in enumerate(prints))


def test_simhash_of_the_table(spark):
    """All documents, and odd ones: nulls, empty and long texts, repeated rows, null ids, clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(i, t, "p", "q", "r", "s", "t") for i, t in TEXTS], SCHEMA).withColumnRenamed("name", "fingerprint")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + TEXTS
    got = simhash.simhash_components(docs.unionByName(odd, allowMissingColumns=True))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == brute_links([(i, brute_fingerprint(t)) for i, t in rows])
    assert queries.QUERIES["op12_simhash"](spark, SF).count() == docs.count()
    assert simhash.simhash_components(docs.limit(0)).collect() == []


def test_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(simhash, "_WINDOW", 7)
    for text in ("Aa  bb\x0bcc dd\tEE ff " * 30, "one two three", "é" * 50 + " x y\nz w", " ", None):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(6)
    w = rng.integers(0, 1 << 23, 3000)
    keys = simhash.golay_keys(w)
    assert set(((keys >= 0).sum(1)).tolist()) == {1, 6}
    one = (1 << np.arange(23)).tolist()
    for e in [0, *one, *(a | b for a, b in itertools.combinations(one, 2))]:
        other = simhash.golay_keys(w ^ e)
        assert ((keys[:, :, None] == other[:, None, :]) & (keys[:, :, None] >= 0)).any((1, 2)).all()


def planted(rng, n, near):
    """Random fingerprints, and `near` of each with at most four bits turned."""
    base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    out = [base]
    for _ in range(near):
        x = base.copy()
        for _ in range(4):
            x ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64) * rng.integers(0, 2, n, dtype=np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("shift", [24, 18, 5])
def test_blocks_find_every_link(shift):
    rng = np.random.default_rng(7)
    cluster = np.unique(np.uint64(rng.integers(0, 1 << 63)) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (700, 3), dtype=np.uint64), axis=1))
    f = np.unique(np.concatenate([planted(rng, 150, 2), cluster]))
    block_of = defaultdict(set)
    for pair in range(3):
        for i, c in enumerate(simhash.cells(f, pair)):
            for x in c[c >= 0] >> shift:
                block_of[pair, int(x)].add(i)
    forest = simhash.Forest(len(f))
    for (pair, block), at in block_of.items():
        u, v = simhash.block_links(f[sorted(at)], pair, shift, block)
        assert len(u) < len(at)
        forest.join(np.searchsorted(f, u), np.searchsorted(f, v))
    least = {}
    for i, r in enumerate(forest.root.tolist()):
        least.setdefault(r, i)
    got = Counter((i, f"{int(x):016x}", least[r]) for i, (x, r) in enumerate(zip(f, forest.root.tolist(), strict=True)))
    assert got == brute_links([(i, int(x)) for i, x in enumerate(f)])


def test_split_blocks(spark, monkeypatch):
    """Blocks beyond PART meet part by part; many blocks, chunks of a task and a hub of near copies."""
    monkeypatch.setattr(simhash, "PART", 300)
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 90)) for _ in range(25)]
    rows = []
    for i in range(900):
        w = base[i % 25 if i % 3 else 0].split()
        for k in rng.integers(0, 90, int(rng.integers(0, 3))):
            w[k] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(tuple(r) for r in got.collect()) == brute_links([(i, brute_fingerprint(t)) for i, t in rows])


# ---- alignment ----

BYTES, PIECES = public_tokenizers.path(queries.BYTES), public_tokenizers.path(queries.PIECES)


def brute_alignment(rows):
    a_tok, b_tok = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tok.encode_special_tokens = True
    from tokenizers.pre_tokenizers import ByteLevel

    own = sorted(ord(c) for c in ByteLevel.alphabet() if ord(c) < 256)
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    a_of = lambda i: bytes(byte[c] for c in a_tok.id_to_token(i))
    b_of = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("\u2581", " ").encode()
    found, count = [], Counter()
    for i, t in rows:
        links, groups, a, b = [], [], [], []
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            if b"".join(map(a_of, a)) != (" " + t).encode() or b"".join(map(b_of, b)) != (" " + t).encode():
                a, b = [], []
        x = y = 0
        ga, gb, ea, eb = [], [], 0, 0
        while x < len(a):
            if not ga:
                ga, gb, ea, eb = [a[x]], [b[y]], ea + len(a_of(a[x])), eb + len(b_of(b[y]))
            links.append((a[x], b[y]))
            if ea == eb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb, x, y = [], [], x + 1, y + 1
            elif ea < eb:
                x += 1
                ga.append(a[x])
                ea += len(a_of(a[x]))
            else:
                y += 1
                gb.append(b[y])
                eb += len(b_of(b[y]))
        count.update(links)
        found.append((i, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return Counter((i, na, nb, len(g), len(ln), sum(count[p] == most[p[1]] for p in ln), sum(count[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, ln in found)


ODD = ["\u2581 x", "</s> <s> <unk> <|endoftext|> <0x41>", " lead", "tail ", "\n\n  a\tb", "Ü𝔘 ﬁ \u0301 e\u0301", "\x00\x01", "\u3000全角", "don't 12345"]


def test_alignment_of_the_table(spark, monkeypatch):
    """Many chunks, flushes, spans and salts; odd texts and clashing columns: as brute force."""
    monkeypatch.setattr(alignment, "LINKS", 5000)
    monkeypatch.setattr(alignment, "DOCS", 60)
    monkeypatch.setattr(alignment, "SALT_ROWS", 3)
    monkeypatch.setattr(alignment, "SALT_LINKS", 4000)
    monkeypatch.setattr(alignment, "SPAN", 9000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 20000")
    odd = spark.createDataFrame([(i, t, "p", "q", "r", "s", "t") for i, t in TEXTS + list(enumerate(ODD, 100))], SCHEMA).withColumnsRenamed({"name": "sha", "key": "stripe"})
    rows = [(r.doc_id, r.text) for r in docs.collect()] + TEXTS + list(enumerate(ODD, 100))
    got = alignment.align_tokens(docs.unionByName(odd, allowMissingColumns=True), BYTES, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(rows)
    assert alignment.align_tokens(docs.limit(0), BYTES, PIECES).collect() == []


def test_spans_are_cut_at_common_ends_only():
    pair = alignment.Pair.of(BYTES, PIECES)
    docs = [pair.tokens(t) for t in ["Donaudampfschifffahrt " * 40, "", "a", "x" * 300]]
    whole, parts = list(alignment.align(pair, docs)), list(alignment.align(pair, docs, span=3))
    assert len(whole) == 1 and len(parts) > 20
    for k in (0, 1, 2):
        assert np.array_equal(whole[0][k], np.concatenate([p[k] for p in parts]))
    assert np.array_equal(whole[0][3], sum(p[3] for p in parts))
    digests = [alignment.Digest() for _ in docs]
    for p in parts:
        for d, s in p[4]:
            digests[d].add(s)
    want = [alignment.Digest() for _ in docs]
    for d, s in whole[0][4]:
        want[d].add(s)
    assert [d.text() for d in digests] == [d.text() for d in want] and digests[1].text() == ""


def test_packed_links_keep_large_numbers():
    keys = np.repeat((np.array([5, 200, 201]) << 20 | np.array([7, 7, 9])) << 20 | np.array([3, 3, 4]), [600, 255, 1])
    rows = list(alignment.pack_links(keys, "<u2"))
    assert [(r[0], r[1]) for r in rows] == [(0, 600), (1, 256)]
    assert np.frombuffer(rows[0][7], "u1").tolist() == [255, 255, 90] and np.frombuffer(rows[1][4], "<u4").tolist() == [1, 1]


# ---- top-k: which blocks are shipped ----


def test_topk_ships_what_may_qualify(spark, monkeypatch):
    """Of vectors with a few long ones, most blocks go to few queries; results are brute force's, and no range loses a vector."""
    rng = np.random.default_rng(11)
    v = np.rint(rng.normal(size=(1500, 6)) * (1 + 400 * (rng.random((1500, 1)) < 0.05) * rng.random((1500, 1)))).astype(int)
    v[:20] = 0
    kept = {}
    monkeypatch.setattr(topk_search, "store", lambda df, tag, f=topk_search.store: kept.setdefault(tag, f(df, tag)))
    df = spark.createDataFrame([(i, (x / 256).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, k=4, every=5, block=100).collect()
    want = set()
    for a in range(0, 1500, 5):
        s = v @ v[a]
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != a][:4]
        want |= {(a, r + 1, int(i), int(s[i])) for r, i in enumerate(order)}
    assert {tuple(r) for r in got} == want
    blocks = kept["asked"].agg({"cb": "max"}).first()[0]
    assert blocks >= 10 and kept["asked"].count() < 0.5 * 300 * blocks
    spans = topk_search.ranges_of({-3: 5, 0: 900, 1: 10, 7: 1, 8: 60}, 100)
    assert [s[:4] for s in spans] == [(8, 8, 0, 1), (0, 7, 1, 10), (-3, -3, 11, 1)] and topk_search.ranges_of({}, 100) == []


# ---- packing: exchanges that cost nothing ----


def test_exchanges_never_cost_a_sequence():
    """On skewed, dense and sparse histograms as few sequences as best-fit decreasing needs, or fewer; every piece is used once."""
    rng = np.random.default_rng(12)
    sequences = lambda patterns: sum(times for times, _ in patterns)
    saved = 0
    for k in range(12):
        size = int(rng.choice([50, 256, 1024]))
        lengths = np.minimum(size, 1 + rng.geometric(rng.choice([0.002, 0.01, 0.05]), 3000)) if k % 2 else rng.integers(1, size + 1, 2000)
        counts = np.bincount(lengths, minlength=size + 1)
        got = packing.fewest(counts)
        used = np.zeros(size + 1, np.int64)
        for times, parts in got:
            assert sum(parts) <= size
            for n in parts:
                used[n] += times
        assert (used == counts).all()
        plain = sequences(packing.best_two_fit(counts, -1))
        assert sequences(got) <= min(plain, sequences(packing.best_two_fit(counts)))
        saved += plain - sequences(got)
    assert saved >= 0 and sequences(packing.fewest(np.bincount([7, 6, 3, 2, 2], minlength=11))) == 2


# ---- language ID: a bounded sample ----


def test_training_rows_are_the_smallest_hashes(spark, monkeypatch):
    """As a window over all rows would pick them, in few rows looked at; a share of bytes bounds 1,000 languages; long first texts."""
    rng = np.random.default_rng(13)
    rows = [(f"l{min(int(x), 40)}", int(h), int(size)) for x, h, size in zip(rng.geometric(0.2, 4000), rng.integers(-(1 << 63), (1 << 63) - 1, 4000), rng.integers(1, 50, 4000), strict=True)]
    rows += rows[:300] + [("big", k, 10**6) for k in range(3)]
    df = spark.createDataFrame(rows, "lang string, h long, size int")
    by = defaultdict(set)
    for lang, h, size in rows:
        by[lang].add((size > 2000, h, size))
    want = set()
    for lang, found in by.items():
        total = 0
        for k, (_, h, size) in enumerate(sorted(found)[:20]):
            total += size
            if k == 0 or total <= 2000:
                want.add((lang, h))
    assert {tuple(r) for r in language_id.pick(df, 20, 2000 * len(by)).collect()} == want
    many = spark.createDataFrame([(f"{k % 1000}", k * 7919, 100) for k in range(6000)], "lang string, h long, size int")
    got = language_id.pick(many, 400, 250_000)
    assert got.count() == 2000 and got.select("lang").distinct().count() == 1000
    docs = spark.createDataFrame([(k, f"t{k % 1000} text", f"{k % 1000}") for k in range(3000)], "doc_id long, text string, lang string")
    model = language_id.train(docs, train_bytes=20_000)
    assert len(model.langs) == 1000 and sum(len(t.levels[0][0]) for t in model.trees) <= 20_000
    assert language_id.pick(df.limit(0), 5, 100).collect() == []


# ---- line dedup: texts that lose nothing stay where they are ----


def test_texts_move_only_if_many_lose_lines(spark, monkeypatch):
    """Few texts with dropped lines are sent to the texts; with a lower bound texts are dealt by key; both give the same."""
    rows = [(k, f"own {k}\nshared" if k < 30 else f"own {k}\n\nother {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = []
    for most in (1 << 19, 5):
        monkeypatch.setattr(line_dedup, "MOST_TEXTS", most)
        got = line_dedup.dedup_lines(df)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (most > 5, most == 5)
        found.append(sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()))
    assert found[0] == found[1] and sum(r[2] for r in found[0]) == 30
