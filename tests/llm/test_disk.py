"""What the pipeline and the Jaccard join leave on disk: no second copy of the texts, no shuffle files, no stage's documents once the next ones are there."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from kinfold.llm import jaccard_join, shared
from kinfold.llm.shared import store

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def text(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


def near(k, n=40):
    return text(k, n).rsplit(" ", 1)[0] + " other"


ROWS = [
    (1, text(1), "en", "a", 1), (2, near(1), "en", "a", 1), (3, text(2), "en", "a", 1),
    *[(4, text(3), "en", "a", 1)] * 3, (5, near(3), "en", "a", 1),  # equal rows that would stay
    *[(7, near(4), "en", "a", 1)] * 2, (6, text(4), "en", "a", 1),  # equal rows that go
    (8, text(5), None, "x", 1), (8, text(5), "x", None, 1), (8, text(5), "x", "x", 1),  # told apart by nulls only
    (None, text(6), "en", "a", 1), (None, text(6), "en", "a", 1), (None, near(6), "en", "a", 1),
    (None, text(1), "en", "a", 1),
    *[(9, None, "en", "a", 0)] * 2, *[(10, " ", "en", "a", 1)] * 2,  # no words: all stay
]


def test_one_row_of_a_group_stays_and_texts_are_not_written_again(spark, folder):
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(ROWS, COLUMNS), "")
    kept = Counter(r.doc_id for r in got.collect())
    assert kept == Counter({1: 1, 3: 1, 4: 1, 6: 1, 8: 1, None: 1, 9: 2, 10: 2})
    tables = {f.parent.name for f in folder.rglob("*.parquet") if "text" in pq.read_schema(f).names}
    assert not tables


def test_documents_of_a_stage_go_once_the_next_are_written(spark, folder, monkeypatch):
    spark.createDataFrame(ROWS, COLUMNS).write.parquet(f"{folder}/in/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda s, docs, d: docs.where("doc_id > 1")) for name in ("one", "two", "three")])
    assert corpus_pipeline.run(spark, f"{folder}/in").count() == sum((r[0] or 0) > 1 for r in ROWS)
    assert [p.name.split("-")[0] for p in (folder / "kinfold").iterdir()] == ["three"]
    assert (folder / "in/documents.parquet").exists()


def test_stored_tables_leave_no_shuffle_files(spark, folder):
    def shuffled():
        return {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split(" ") if "/shuffle_" in x}

    df, before = spark.range(1000).selectExpr("id % 100 as k").groupBy("k").count(), shuffled()
    counts = store(df, "counts")
    assert shuffled() <= before
    assert counts.count() == 100
    assert store(df, "counts").agg({"count": "sum"}).first()[0] == 1000  # the same frame once more


def test_gaps_of_far_numbers_stay_small():
    rng = np.random.default_rng(5)
    for n in (128, 512, 16384, 1 << 17):  # as of 24 bits; few of a blob's tokens are in one of many buckets
        x = np.sort(rng.integers(0, 1 << 24, n))
        packed = jaccard_join.gaps_of(x)
        assert jaccard_join.from_gaps(packed).tolist() == x.tolist()
        assert len(packed) <= 8 + n * (np.log2((1 << 24) / n) + 2.2) / 8
    for x in ([0], [0, 0, 0], [(1 << 24) - 1], [5] * 1000, [0] * 50 + [(1 << 24) - 1]):
        assert jaccard_join.from_gaps(jaccard_join.gaps_of(np.array(x, np.int64))).tolist() == x
