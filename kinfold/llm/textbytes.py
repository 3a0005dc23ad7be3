"""Numpy views of Arrow text columns, and hashing of words and shingles over them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: The ASCII white space that separates words and is stripped from lines.
SPACE = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.isin(np.arange(256), list(SPACE))
LOWER_TABLE = bytes(LOWER)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 data and offsets of a text column; null is empty. No copy unless there are nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow; what a task has freed goes back to the system at its end, as workers live on for other stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return whole


def groups(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, U)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) of the rows, and how many words precede each row (rows + 1 values)."""
    a, z = int(offs[0]), int(offs[-1])
    data, ends = LOWER[raw[a:z]], offs - a
    word = ~IS_SPACE[data]
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    cut = ends[:-1][ends[:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    cut = ends[1:][ends[1:] > 0] - 1
    after[cut] = False
    end = np.flatnonzero(word & ~after) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + U(0x632BE59BD9B4E019)), np.searchsorted(start, ends)


_WEIGHTS = [U(pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1) for k in range(64)]


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its word shingles; with fewer than width words, its whole sequence as one."""
    h, at = word_hashes(raw, offs)
    n = len(h)
    whole = np.zeros(max(0, n - width + 1), U)
    for k in range(width):
        whole += h[k : k + len(whole)] * _WEIGHTS[k]
    whole = mix(whole)
    for i in range(len(offs) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            short = sum((h[a + k : a + k + 1] * _WEIGHTS[k] for k in range(b - a)), np.zeros(1, U))
            yield mix(short + U(b - a))
        else:
            yield np.zeros(0, U)
