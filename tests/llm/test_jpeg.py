"""The JPEG reader against an encoder of its own with all that a progressive scan may hold, and the transform against its definition."""

import numpy as np
import pytest

from kinfold.llm import progressive_jpeg as pic


class Writer:
    """Bits of a scan; every symbol in use has a code of 16 bits, in order."""

    def __init__(self, symbols):
        self.code, self.bits = {s: i for i, s in enumerate(symbols)}, []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(self.code[s], 16)

    def signed(self, v):
        n = int(abs(v)).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def end(self):
        bits = np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)
        self.bits = []
        return pic._stuff(np.packbits(bits).tobytes())


SYMBOLS = sorted({r << 4 | n for r in range(16) for n in range(11)} | {r << 4 for r in range(15)})


def down(v, al):
    """Towards zero, as AC coefficients are cut."""
    return int(np.sign(v)) * (int(abs(v)) >> al)


def ac_first(w, blocks, ss, se, al):
    run = 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(ss, se + 1):
            v = down(b[k], al)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | abs(v).bit_length())
            w.signed(v)
            zeros = 0
        if zeros:
            run += 1
    flush()


def ac_refine(w, blocks, ss, se, al):
    run, late = 0, []

    def flush():
        nonlocal run, late
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            w.bits += late
            run, late = 0, []

    for b in blocks:
        size = [int(abs(v)) >> al for v in b]
        last = max((k for k in range(ss, se + 1) if size[k] == 1), default=-1)
        zeros, more = 0, []
        for k in range(ss, se + 1):
            if not size[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                flush()
                w.symbol(0xF0)
                w.bits += more
                zeros, more = zeros - 16, []
            if size[k] > 1:
                more.append(size[k] & 1)
                continue
            flush()
            w.symbol(zeros << 4 | 1)
            w.put(int(b[k] > 0), 1)
            w.bits += more
            zeros, more = 0, []
        if zeros or more:
            run += 1
            late += more
    flush()


def jpeg(coef, height, width, sampling, restart):
    """coef: by component, block rows x block columns x 64 in zigzag order, whole macroblocks."""
    out = [b"\xff\xd8", pic._segment(0xDB, bytes([0, *range(1, 65)]))]
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(coef)])
    out.append(pic._segment(0xC2, frame + b"".join(bytes([c, h << 4 | v, 0]) for c, (h, v) in sampling.items())))
    for place in (0x00, 0x10):
        out.append(pic._dht(place, {16: SYMBOLS}))
    if restart:
        out.append(pic._segment(0xDD, restart.to_bytes(2, "big")))
    most = [max(s[k] for s in sampling.values()) for k in (0, 1)]
    across, rows = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    w = Writer(SYMBOLS)

    def scan(comps, ss, se, ah, al, units, write):
        out.append(pic._sos(comps, ss, se, ah, al))
        step = restart or len(units)
        for k in range(0, len(units), step):
            if k:
                out.append(bytes([0xFF, 0xD0 + (k // step - 1) % 8]))
            write(units[k : k + step])
            out.append(w.end())

    def dc_first(units):
        last = {}
        for unit in units:
            for c, b in unit:
                v = int(b[0]) >> 1
                w.symbol(abs(v - last.get(c, 0)).bit_length())
                w.signed(v - last.get(c, 0))
                last[c] = v

    mcus = [[(c, coef[c][r * v + y, x * h + i]) for c, (h, v) in sampling.items() for y in range(v) for i in range(h)] for r in range(rows) for x in range(across)]
    scan(list(coef), 0, 0, 0, 1, mcus, dc_first)
    scan(list(coef), 0, 0, 1, 0, mcus, lambda units: w.bits.extend(int(b[0]) & 1 for unit in units for _, b in unit))
    for c, (h, v) in sampling.items():
        own = (-(-(-(-height * v // most[1])) // 8), -(-(-(-width * h // most[0])) // 8))
        blocks = list(coef[c][: own[0], : own[1]].reshape(-1, 64))
        for ss, se in ((1, 5), (6, 63)):
            scan([c], ss, se, 0, 2, blocks, lambda bs, ss=ss, se=se: ac_first(w, bs, ss, se, 2))
        for al in (1, 0):
            scan([c], 1, 63, al + 1, al, blocks, lambda bs, al=al: ac_refine(w, bs, 1, 63, al))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("sampling", [{1: (2, 2), 2: (1, 1), 3: (1, 1)}, {1: (1, 1)}, {1: (2, 1), 2: (1, 1), 3: (1, 1)}])
def test_reads_all_of_a_progressive_scan(sampling, restart):
    """Negative values, long runs of ended blocks, runs of over 15 zeros, refinements, odd sizes, restarts."""
    rng = np.random.default_rng(9)
    height, width = 45, 53
    most = [max(s[k] for s in sampling.values()) for k in (0, 1)]
    across, rows = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    coef = {}
    for c, (h, v) in sampling.items():
        x = np.rint(rng.laplace(0, 6, (rows * v, across * h, 64)) * (rng.random((rows * v, across * h, 64)) < rng.choice([0.02, 0.2, 0.9], (rows * v, across * h, 1)))).astype(np.int64)
        x[rng.random(x.shape[:2]) < 0.4, 1:] = 0
        x[..., 0] = rng.integers(-500, 500, x.shape[:2])
        own = (-(-(-(-height * v // most[1])) // 8), -(-(-(-width * h // most[0])) // 8))
        x[own[0] :, :, 1:] = 0
        x[:, own[1] :, 1:] = 0
        coef[c] = x
    p = pic.Picture(jpeg(coef, height, width, sampling, restart))
    for c in coef:
        assert (p.coef[c] == coef[c]).all()
    got = p.rgb()
    assert got.shape == (height, width, 3)
    assert_transform(p)


def assert_transform(p):
    """Samples are the definition's, rounded, but for what a basis of 15 bits may be off (2 ** -16 of the coefficients' sum); colours within one level of their formula."""
    for (c, (_, _, q)), got, want in zip(p.comps.items(), p.planes(), by_definition(p), strict=True):
        off = np.abs(p.coef[c] * p.quant[q]).sum(-1).max() * 2.0**-16
        assert off < 0.5 and np.abs(got - want).max() <= 0.5 + off
    planes = [x.astype(float) for x in p.planes()]
    if len(planes) == 1:
        assert (p.rgb() == planes[0][:, :, None]).all()
        return
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    assert np.abs(p.rgb() - np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)).max() <= 1


def by_definition(p):
    """The samples by the double sum of the transform, in doubles."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(u == 0, 0.5**0.5, 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)
    planes = []
    for c, (h, v, q) in p.comps.items():
        rows, cols, _ = p.coef[c].shape
        s = np.zeros((rows, cols, 64))
        s[..., pic.ZIGZAG] = p.coef[c] * p.quant[q]
        y = np.einsum("rcvu,vy,ux->rycx", s.reshape(rows, cols, 8, 8), basis, basis).reshape(rows * 8, cols * 8)
        y = np.clip(y + 128, 0, 255)
        planes.append(y.repeat(p.v // v, 0).repeat(p.h // h, 1)[: p.height, : p.width])
    return planes


def test_payload_pictures_are_exact():
    rng = np.random.default_rng(10)
    for k in (1, 4):
        p = pic.Picture(pic.encode(rng.integers(0, 256, 576 * k).astype(np.uint8)))
        assert_transform(p)


def test_feature_and_clashing_columns(spark):
    """The stored tensors give the feature; columns with the names of added ones are replaced, others stay."""
    rows = [(1, "abc", "x", 5, "m"), (2, None, None, None, None), (2, "abc", "y", 6, "n"), (None, "é" * 700, "z", 7, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string, n_bytes int, kept string")
    got = pic.media_columns(df).collect()
    assert set(df.columns) - {"feature", "n_bytes"} <= set(got[0].asDict()) and [r.kept for r in got] == [r[4] for r in rows]
    for r, (_, text, *_rest) in zip(got, rows, strict=True):
        pictures = [pic.Picture(x) for x in pic.encode_all(pic.pad((text or "").encode()))]
        tensor = np.frombuffer(r.rgb, np.uint8).reshape(r.height, 16, 3)
        assert (tensor == np.concatenate([p.rgb() for p in pictures])).all()
        assert r.feature == ":".join(map(str, (r.height, *(tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (16 * r.height)).tolist())))
    assert got[0].feature == got[2].feature and [r.n_bytes for r in got] == [3, 0, 3, 1400]
