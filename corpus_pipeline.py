"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes all rows that the one before kept and returns the columns of documents; the last returns the packed
pieces. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import jaccard_join, language_id, line_dedup, packing
from kinfold.llm.queries import BYTES, held_out
from kinfold.llm.shared import drop_stored, small, store

#: Hashes of rows (16 bytes each) that are sent to all tasks; beyond that rows are dropped by a shuffle.
MOST_BROADCAST = 1 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts and texts without a letter. lang becomes the predicted language.

    Repeated rows stay, each with the same language; ties go to the first language in order; null ids and null langs play no
    part but that their rows teach nothing. Where no row teaches a language all documents go. An empty table stays empty.
    """
    model = language_id.train(docs.where(~held_out()))
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents hold go from every document; no document goes. n_chars follows the text, which may be empty then.

    A null text is one empty line and becomes an empty text. Repeated rows are documents each and lose the same lines; null ids, langs and
    sources stay as they are. An empty table stays empty.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10, out=("n_lines", "n_dropped", "text", "kept_sha256"), keep=[c for c in COLUMNS if c != "text"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, a row with the smallest id; all documents without words stay.

    Of repeated rows one stays; a group whose ids are all null keeps one row as well. Rows are told apart by 128 bits of hashes
    of all their columns, as ids may be null or repeated: no text is written again beside docs. Rows that are equal in all
    columns have the same hashes; those that would stay are made one.
    """
    values = [f(c) for c in COLUMNS for f in (F.isnull, F.col)]  # a hash passes over nulls
    rows = docs.select(*COLUMNS, F.xxhash64(*values).alias("__x"), F.xxhash64(F.lit(1), *values).alias("__y"))
    found = jaccard_join.jaccard_components(rows.select(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "__x", "__y").alias("__row"), "text"), row_id="__row")
    found = found.where("n_shingles > 0").select("__row.__x", "__row.__y", (F.col("__row") != F.col("component_id")).alias("copy"))
    gone = store(found.where("copy").select("__x", "__y").distinct(), "gone")
    many = store(found.where("not copy").groupBy("__x", "__y").count().where("count > 1").select("__x", "__y"), "many")
    out = rows.join(small(gone, MOST_BROADCAST), ["__x", "__y"], "left_anti")
    if not many.isEmpty():
        many = small(many, MOST_BROADCAST)
        out = out.join(many, ["__x", "__y"], "left_anti").union(out.join(many, ["__x", "__y"], "left_semi").select("__x", "__y", *COLUMNS).dropDuplicates(["__x", "__y"]))
    return out.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens; nulls, empty texts and repeated rows as packing.pack has them."""
    return packing.pack(docs, public_tokenizers.path(BYTES), 1024, 2)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("jaccard_join", drop_near_copies), ("packing", pack)]

#: Language ID by partial matching has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. An empty table, or one whose documents all go, gives no pieces. A stage's documents go once the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        drop_stored(before)
    return docs
