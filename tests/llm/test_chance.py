"""Shingles that unrelated texts share by chance: their number grows as the square of the input, what is moved for them must not."""

import random
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import jaccard_join


def texts(n=200, words=60):
    """Unrelated texts, each two neighbours with one shingle in common, and a near copy of every tenth."""
    rows = []
    for k in range(n):
        w = [f"t{k}x{i}" for i in range(words)]
        w[10:15], w[40:45] = [f"s{k}y{i}" for i in range(5)], [f"s{k + 1}y{i}" for i in range(5)]
        rows.append((k, " ".join(w)))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join([*w[:-1], "other"])))
    return rows


@pytest.mark.parametrize("cell_bits", [29, 1])
def test_chance_shingles_are_not_sent(spark, monkeypatch, cell_bits):
    """With cells for all tokens, postings are those of near copies alone; with too few cells nothing is left out that could meet."""
    path, lists = spark.sparkContext.accumulator(0), jaccard_join._lists

    def counted(num, den, lim):
        run = lists(num, den, lim)

        def count(key, table):
            path.add(sum(len(x.as_py()) // 4 for x in table.column("token")))
            return run(key, table)

        return count

    monkeypatch.setattr(jaccard_join, "_lists", counted)
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, lim=jaccard_join.Limits(bucket=1 << 10, cell_bits=cell_bits)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, i % 1000) for i, _ in texts())
    if cell_bits == 29:
        assert 0 < path.value <= 40 * 15 * 2  # 40 of 220 texts have a near copy, a prefix is of 15 tokens


def test_gaps_and_cells():
    rng = random.Random(3)
    x = np.array(sorted([rng.randrange(1 << 24) for _ in range(500)] + [0, 0, 65534, 65535, 65535, 65536, (1 << 24) - 1]), np.int64)
    assert jaccard_join.from_gaps(jaccard_join.gaps_of(x)).tolist() == x.tolist()
    assert jaccard_join.from_gaps(jaccard_join.gaps_of(x[:0])).tolist() == []
    low, n = np.arange(64, dtype=np.uint32) << 18, np.array([1, 2] * 32)
    cells, whole = jaccard_join.repeated_cells(low, n, 6)
    assert whole and np.unpackbits(np.frombuffer(cells, np.uint8)).tolist() == [0, 1] * 32
    cells, whole = jaccard_join.repeated_cells(low, np.arange(1, 65), 3)
    assert not whole and np.unpackbits(np.frombuffer(cells, np.uint8)).sum() == 1
