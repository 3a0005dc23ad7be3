import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from compare import same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import chat_format, jaccard_join, language_id, line_dedup, packing, progressive_jpeg, queries, sentencepiece_trie, token_counts, topk_search, url_filters
from kinfold.llm.shared import connected_components, shared_dir

SF = "/root/testdata/sf0.001"
MODEL, BYTES = public_tokenizers.path(queries.PIECES), public_tokenizers.path(queries.BYTES)
LONG = "ein Wort und noch eins. " * 9000
TEXTS = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (4, "a b c"), (None, "x\ny\nÜber </s> [INST]"), (6, LONG), (7, "\n\n"), (8, "  \t "), (9, "nospace" * 2000)]
SCHEMA = "doc_id long, text string, n_lines string, n_tokens string, length string, name string, key string"


@pytest.fixture
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "p", "q", "r", "s", "t") for i, t in TEXTS], SCHEMA)


def sf(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in index[g])
        for g in s:
            index[g].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return Counter((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_topk(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.25]), (6, [1.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 98304), (0, 2, 2, 98304), (50, 1, 1, -24576), (50, 2, 2, -24576)]
    rng = np.random.default_rng(1)
    c, q = rng.integers(-90, 90, (3000, 16)), rng.integers(-90, 90, (20, 16))
    for big in (1, 1 << 40):  # exact beyond doubles as well
        few = c[:300] if big > 1 else c
        for i, ids, scores, _ in topk_search.nra(q * big, np.arange(20), few, np.arange(len(few)), 5):
            s = few @ q[i]
            order = [x for x in np.lexsort((np.arange(len(few)), -s)) if x != i][:5]
            assert ids.tolist() == order and scores.tolist() == (s[order] * big).tolist()


def test_topk_stops_early():
    """Skewed vectors: few candidates are large, so reading stops long before the lists' end; under a floor a block is skipped unread."""
    rng = np.random.default_rng(2)
    c = np.rint(rng.pareto(1.2, (4000, 1)) * rng.integers(1, 60, (4000, 8))).astype(np.int64)
    q = rng.integers(-5, 90, (30, 8))
    got = topk_search.nra(q, np.full(30, -1), c, np.arange(4000), 5)
    for i, ids, scores, depth in got:
        s = c @ q[i]
        order = np.lexsort((np.arange(4000), -s))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == s[order].tolist() and depth <= 0.5
    floor = np.full(30, float((c @ q.T).max() + 1) * 10)
    assert all(not len(ids) and depth == 0 for _, ids, _, depth in topk_search.nra(q, np.full(30, -1), c, np.arange(4000), 5, floor))


def test_topk_blocks(spark):
    """Many blocks, ties, repeated ids, and columns with the names of the output: as brute force."""
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (400, 4)).astype(float)
    rows = [(i % 390, v[i].tolist(), 1) for i in range(400)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), k=3, every=20, block=50).collect()
    least = {}
    for i, x, _ in rows:
        least[i] = min(least.get(i, x), x)
    want = set()
    for a in range(0, 390, 20):
        best = sorted((-int(256 * 256 * np.dot(least[a], least[b])), b) for b in least if b != a)[:3]
        want |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_line_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in sf(spark).select("doc_id", "text").collect()] + TEXTS
    count = Counter(k for _, t in rows for k in {x for x in line_dedup.line_keys(t) if x})
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, line_dedup.line_keys(t), strict=True) if not (k and count[k] >= 3)]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = line_dedup.dedup_lines(sf(spark).select("doc_id", "text").union(docs.select("doc_id", "text")), min_docs=3)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == want
    assert set(line_dedup.dedup_lines(docs).columns) == {*docs.columns, "n_dropped", "kept_text", "kept_sha256"}


def test_line_dedup_groups_do_not_grow_with_copies(spark, monkeypatch):
    """Of a text of many copies each dropped line is named once, in a probe's answer and in what is collected."""
    collect = []
    monkeypatch.setattr(line_dedup.F, "collect_list", lambda c, f=F.collect_list: collect.append(c) or f(c))
    stored, store = {}, line_dedup.store
    monkeypatch.setattr(line_dedup, "store", lambda df, tag: stored.update({tag: df}) or store(df, tag))
    df = spark.createDataFrame([(k, "one\ntwo\nthree") for k in range(300)] + [(300, "one\nfour")], "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df)
    assert collect == ["line"]
    plan = stored["drops"]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[k1#\d+L, k2#\d+L, line#\d+\], \[k1#\d+L, k2#\d+L, line#\d+\]", plan), plan
    assert Counter((r.n_dropped, r.kept_text) for r in got.collect()) == {(3, ""): 300, (1, "four"): 1}
    hi, lo, n = np.array([5], np.uint64), np.array([6], np.uint64), np.array([40])
    shard = {"shard": 0, **line_dedup.build_mph(hi, lo, n)}
    probe = {"shard": 0, "salt": 0, "k1": np.full(40, 1).tobytes(), "k2": np.full(40, 2).tobytes(), "line": np.zeros(40, np.int32).tobytes(), "hi": hi.repeat(40).tobytes(), "lo": lo.repeat(40).tobytes()}
    schema = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("sizes", "bits", "prints", "counts")), ("salt", pa.int32()), *((c, pa.binary()) for c in ("k1", "k2", "line", "hi", "lo"))])
    rows = [r for b in line_dedup._probe(10)(pa.Table.from_pylist([shard, probe], schema).to_batches()) for r in b.to_pylist()]
    assert rows == [{"k1": 1, "k2": 2, "line": 0}]


def test_mph():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    n = rng.integers(1, 99, 5000)
    m = line_dedup.Mph(**line_dedup.build_mph(hi, lo, n))
    assert (m.count(hi, lo) == n).all() and len(m.counts) == 5000
    assert not m.count(hi + np.uint64(1), lo ^ np.uint64(5)).any()


def test_token_counts(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count_tokens(docs, MODEL).collect()
    assert [r.n_tokens for r in got] == [len(sp.encode(t or "")) for _, t in TEXTS]
    enc = token_counts.Encoder(MODEL, chunk=60, overlap=4, huge=80)
    assert enc.stable_cuts
    rng = random.Random(0)
    for _ in range(1500):
        t = "".join(rng.choice("ab  \n▁é中") for _ in range(rng.randint(0, 600)))
        assert enc.encode(t).tolist() == sp.encode(t)
    assert enc.spliced and enc.widened


def test_sentencepiece(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentencepiece_trie.encode_decode(docs, MODEL).collect()
    assert [r.ids for r in got] == [sp.encode(t or "") for _, t in TEXTS]
    assert [r.decoded for r in got] == [t or "" for _, t in TEXTS]
    trie, rng = sentencepiece_trie.Trie(MODEL), random.Random(1)
    texts = ["".join(rng.choice(["the", "a", "  ", "\n", "ing", "aaaa", "é", "中", "00", "==", "th", "re", "er", " "]) for _ in range(40)) for _ in range(2000)]
    ids, at = trie.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == sp.encode(texts)
    assert trie.saved > 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\s> \ <\\|end|> <|end|>", None, "", "a\nb", LONG]
    rows = [(c, t, "assistant" if t % 2 else "user\\\n</s><\\|end|>", x, "u") for c in (None, 5) for t, x in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    formatted = chat_format.format_chats(df)
    parts = formatted.collect()
    assert all(x not in p.formatted.replace("<|turn|>", "").replace("<|end|>", "").removeprefix("<s>") for p in parts for x in chat_format.CONTROL)
    for r in chat_format.digest_chats(formatted).collect():
        turns = sorted((t, role, x or "") for c, t, role, x, _ in rows if c == r.conv)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (12, len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_language_id(spark, docs):
    data = sf(spark)
    model = language_id.train(data.where(~queries.held_out()))
    got = language_id.identify(data, model).where(queries.held_out()).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = language_id.identify(docs, model).collect()
    assert [r.lang_pred == "und" for r in odd] == [t is None or not re.search(r"[^\W\d_]", t) for _, t in TEXTS]
    many = spark.createDataFrame([(k, "abc " * (k % 7 + 1) + chr(97 + k % 26) * 20 + str(k) * 10, f"l{k:03}") for k in range(100)], "doc_id long, text string, lang string")
    wide = language_id.train(many)
    assert len(wide.langs) == 100 and sum(r.lang == r.lang_pred for r in language_id.identify(many, wide).collect()) >= 95
    for none in (data.limit(0), data.withColumn("lang", F.lit(None).cast("string"))):
        assert {(r.lang_pred, r.score, r.bits_per_byte) for r in language_id.identify(data, language_id.train(none)).collect()} == {("und", 0.0, None)}
    assert language_id.identify(data.limit(0), model).count() == 0
    clash = language_id.identify(docs.withColumnsRenamed({"n_lines": "score", "n_tokens": "lang_pred"}), model)
    assert clash.columns == ["doc_id", "text", "length", "name", "key", "lang_pred", "score", "bits_per_byte"] and clash.count() == len(TEXTS)


def brute_bits(train, text):
    """Prediction by partial matching, one byte after the other, from counts in dictionaries."""
    followers = defaultdict(Counter)
    for t in train:
        b = bytes(3) + t
        for k in range(3, len(b)):
            for depth in range(4):
                followers[depth, b[k - depth : k]][b[k]] += 1
    bits, b = 0.0, bytes(3) + text
    for k in range(3, len(b)):
        p = 1.0
        for depth in (3, 2, 1, 0):
            seen = followers.get((depth, b[k - depth : k]))
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[k] in seen:
                bits -= math.log2(p * seen[b[k]] / whole)
                break
            p *= len(seen) / whole
        else:
            bits -= math.log2(p / 256)
    return bits


def test_language_id_code_lengths(spark, monkeypatch):
    langs = {"x": ["the cat sat on the mat", "Übung macht den Meister"], "y": ["aaaaabaaab", "la vie en rose \U0001f642"]}
    rows = [(k, t, lang) for lang, ts in langs.items() for k, t in enumerate(ts)]
    rows += [(0, "the cat sat on the mat", "x")]  # repeated: teaches once
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t.encode() for t in ("", "the bat", "Über", "zzz \U0001f642\x00", "aab" * 50, "la cat")]
    raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [[brute_bits([x.encode() for x in langs[lang]], t) for lang in ("x", "y")] for t in texts]
    assert np.allclose(model.code_lengths(raw, offs), want)
    monkeypatch.setattr(language_id, "PIECE", 7)  # texts in many pieces
    assert np.allclose(model.code_lengths(raw, offs), want)


def test_jpeg(spark, docs):
    rng, pic = np.random.default_rng(0), progressive_jpeg
    for k in (1, 2, 3, 5):
        p = rng.integers(0, 256, 576 * k).astype(np.uint8)
        fast = pic.Picture(pic.encode(p))
        assert (fast.payload() == p).all() and fast.rgb().shape == (16 * -(-3 * k // 2), 16, 3)
        whole, pic.Picture._whole = pic.Picture._whole, lambda *a: False
        try:
            slow = pic.Picture(pic.encode(p))
        finally:
            pic.Picture._whole = whole
        assert all((slow.coef[c] == fast.coef[c]).all() for c in (1, 2, 3))
    for r, (_, t) in zip(pic.media_columns(docs).collect(), TEXTS, strict=True):
        data = pic.pad((t or "").encode()).tobytes()
        assert (r.payload_bytes, r.payload_sha256, r.media_bytes) == (len(data), hashlib.sha256(data).hexdigest(), len(r.media))
        assert len(r.rgb) == r.height * 48


def test_url_filters(spark):
    pages = [
        (1, "http://a.net/x", '<link rel="canonical" href="http://b.example.org/es/1">'), (2, "http://c.net/y", '<meta http-equiv="refresh" content="0; url=/z">'), (3, "http://c.net/z", "<link href='http://A.net/x#f' rel=canonical>"),
        (4, "http://d.org/q", '<link rel="canonical" href="http://a.net/x">'), (5, None, None), (6, "nothing", "<link rel=canonical href=/x>"), (7, "http://e.net/", "canonical"),
    ]
    got = url_filters.judge(spark.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, node string"), queries.RULES)
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: ("org/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow")}


def test_url_aliases_on_random_graphs(spark):
    """Every page links some others, several times and in entities; verdicts as by union-find over URLs."""
    rng = random.Random(8)
    urls = [f"http://{h}.{t}/p?a={k}&b=1" for k in range(60) for h, t in [rng.choice([("a", "net"), ("www.b", "com"), ("c", "org")])]] + ["http://x.com/de/1", "http://y.com/fr/2"]
    pages, edges = [], []
    for k, u in enumerate(urls * 2):  # repeated rows
        to = [rng.choice(urls) for _ in range(rng.choice([0, 0, 1, 2]))]
        edges += [(u, v) for v in to]
        tag = lambda v: rng.choice([f'<LINK rel=canonical href="{v}">', f"<link href='{v}#x' rel='canonical'/>", f'<meta http-equiv="refresh" content="0; url={v}">'])
        pages.append((k, u, "<p>" + "\n".join(tag(v.replace("&", "&amp;")) for v in to)))
    parent = {u: u for u in urls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)

    def rule(u):
        host, _, path = u.split("://")[1].partition("/")
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    bad = {find(u) for u in urls if rule(u) and rule(u).verdict == "block"}
    got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.RULES).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(k, rule(u).text, rule(u).verdict) if rule(u) else (k, None, "block" if find(u) in bad else "allow") for k, u, _ in pages}
    assert len({r.verdict for r in got if r.rule is None}) == 2 and len(got) == len(pages)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(50)] + [(None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, docs, small):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)]
    near = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 9)}"
        near.append((1000 + k, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in sf(spark).select("doc_id", "text").collect()] + TEXTS + near
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, name string")
    lim = jaccard_join.Limits(long=3, group=4, group_tokens=400, grid=4, grid_tokens=400, slice=4, broadcast=9, hot=3, bucket=1 << 12, hot_part=8, name_bits=9) if small else None
    got = jaccard_join.jaccard_components(df, lim=lim).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def test_jaccard_copies_and_few_near_copies(spark):
    """Short texts of hundreds of copies and one near copy each: in a split list a set may be alone in its part."""
    rows = []
    for g in range(30):
        w = [f"g{g}x{k}" for k in range(8)]
        rows += [(1000 * g + k, " ".join(w)) for k in range(1, 201)] + [(1000 * g, " ".join([*w, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, lim=jaccard_join.Limits(hot_part=4)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, i - i % 1000) for i, _ in rows)


def test_jaccard_splits_every_long_list(spark, monkeypatch):
    """Many distinct near copies: no group of postings holds one token's list whole, wherever its hash lies."""
    rng, lists = random.Random(7), jaccard_join._lists
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join([*base[:p], f"w{k}", *base[p:]])) for k in range(400) for p in [rng.randrange(120)]]

    def bounded(num, den, lim):
        run = lists(num, den, lim)

        def checked(key, table):
            token = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("token")])
            most = int(np.unique(token, return_counts=True)[1].max())
            assert most <= 3 * lim.hot_part, f"{most} postings of one token in part {key[1]} of bucket {key[0]}"
            return run(key, table)

        return checked

    monkeypatch.setattr(jaccard_join, "_lists", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, lim=jaccard_join.Limits(hot_part=20, max_hot=4)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 400


def test_packing(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SALT_PIECES", 2)
    tok = Tokenizer.from_file(BYTES)
    own = docs.union(spark.createDataFrame([(20, "a <|endoftext|> b"), (21, "<|endoftext|>" * 700), (22, "<|endof|>")] + [(30, "x")] * 9, "doc_id long, text string").select("*", *(F.lit("q").alias(c) for c in docs.columns[2:])))
    texts = [(r.doc_id, r.text) for r in own.collect()]
    got = packing.pack(own, BYTES).collect()
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.update((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    enc, rng = packing.encoder(BYTES), random.Random(3)
    pool = [*"ab  \n\t.'s0123éßあ\U0001f642\u0301\u200d\xa0\x00\ufeff", "<|endoftext|>", "<|endof", "'ll", " the"]
    texts = [r.text for r in sf(spark).select("text").collect()] + ["".join(rng.choice(pool) for _ in range(30)) for _ in range(2000)]
    for t in texts:
        assert packing.ids_of(enc, t).tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_best_two_fit():
    counts = np.zeros(11, np.int64)
    counts[[6, 4, 3, 1]] = 1, 1, 2, 1  # greedy 6 + 4, 3 + 3 + 1
    assert sum(t for t, _ in packing.best_two_fit(counts)) == 2
    rng = np.random.default_rng(0)
    counts = np.append(0, rng.integers(0, 50, 100))
    packed = packing.best_two_fit(counts)
    used = Counter()
    for times, parts in packed:
        assert sum(parts) <= 100
        for p in parts:
            used[p] += times
    assert used == Counter({i: int(n) for i, n in enumerate(counts) if n})
    least = max(np.arange(101) @ counts / 100, counts[51:].sum())  # no two over half a sequence share one
    assert sum(t for t, _ in packed) <= 1.02 * least + 1


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert line_dedup.dedup_lines(none).count() == 0 and token_counts.count_tokens(none, MODEL).count() == 0 and sentencepiece_trie.encode_decode(none, MODEL).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0 and packing.pack(none, BYTES).count() == 0 and progressive_jpeg.media_columns(none).count() == 0
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string"), queries.RULES).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = sf(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        got = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "language_id":
            assert got.keys() == {i for i, t in rows if t and re.search(r"[^\W\d_]", t)}
        if name == "line_dedup":
            count = Counter(k for _, t in rows for k in {x for x in line_dedup.line_keys(t) if x})
            assert got == {i: "\n".join(x for x, k in zip(t.split("\n"), line_dedup.line_keys(t), strict=True) if not (k and count[k] >= 10)) for i, t in rows}
        if name == "jaccard_join":
            assert got.keys() == {i for i, n, c in brute_components(rows) if i == c or not n}
    assert corpus_pipeline.run(spark, SF).where(F.col("piece") == 0).count() == docs.count()


def test_pipeline_stages_take_anything(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns, and no rows."""
    import corpus_pipeline

    rows = [(i, t, lang, None, None, "x") for i, t in TEXTS for lang in (None, "de")] + [(None, "five words of one text here", None, None, None, None)] * 3 + [(None, None, None, None, None, None)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string")
    for docs in (some, some.limit(0), some.withColumn("lang", F.lit(None).cast("string"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF).collect()
            if name == "line_dedup":
                assert len(out) == docs.count()
            if name == "jaccard_join":
                blank, different = [t for _, t, *_ in rows if not words(t)], {tuple(words(t)) for _, t, *_ in rows if words(t)}
                assert len(out) == (len(blank) + len(different) if docs.count() else 0)
                assert {r.doc_id for r in out if r.text == "a b c"} <= {3}
            if name == "packing":
                assert {(r.doc_id, r.piece) for r in out} >= {(r.doc_id, 0) for r in docs.collect()}


def test_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session).startswith("file://")
