"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes deep is frozen after training. A byte's probability in a
context seen c times with d distinct followers is n / (c + d) if it followed n times, else the escape d / (c + d) times
its probability in the next shorter context, down to a uniform distribution over bytes. As statistics are frozen, the
code length of every (context, byte) is fixed. A tree holds what its language's rows hold and nothing else: sorted
arrays of the contexts and of what followed them, at each depth. Texts are scored in groups, each distinct sequence of
ORDER + 1 bytes once for each language. Training takes at most SAMPLE rows of each language (the smallest by hash), and no
more of them than its share of TRAIN_BYTES: documented bounds, which bound the model as well, as a byte adds one sequence at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, store
from .textbytes import frugal, groups, text_bytes

ORDER, SAMPLE, PIECE = 3, 400, 1 << 18
#: Bytes of text that all languages together are learned from; picked rows that are sent to all tasks.
TRAIN_BYTES, MOST_BROADCAST = 1 << 24, 1 << 20
UNKNOWN = "und"


class Tree:
    """One language's contexts. A sequence of bytes is a big-endian integer; 0 bytes stand before a text's start."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        """How often (n) each sequence of ORDER + 1 bytes (gram) was seen."""
        self.levels = []
        for depth in range(ORDER, -1, -1):
            keys, at = np.unique(gram & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)  # context and byte
            count = np.bincount(at, n, len(keys))
            contexts, at = np.unique(keys >> 8, return_inverse=True)
            kinds = np.bincount(at, minlength=len(contexts))
            whole = np.bincount(at, count, len(contexts)) + kinds
            self.levels.append((keys, np.log2(whole[at] / count), contexts, np.log2(whole / kinds)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each sequence's last byte after the others."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for depth, (keys, own, contexts, escape) in zip(range(ORDER, -1, -1), self.levels, strict=True):
            g = gram[left] & ((1 << 8 * (depth + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            seen = keys[at] == g
            out[left[seen]] += own[at[seen]]
            left, g = left[~seen], g[~seen] >> 8
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            known = contexts[at] == g
            out[left[known]] += escape[at[known]]
        out[left] += 8
        return out


def grams_of(raw: np.ndarray, offs: np.ndarray, start: int, end: int) -> np.ndarray:
    """For each byte of raw[start:end] its sequence: it and the ORDER bytes before it in its row. offs: where rows begin."""
    lo = max(start - ORDER, 0)
    x = np.concatenate([np.zeros(ORDER - (start - lo), np.int64), raw[lo:end].astype(np.int64)])
    inside = np.arange(start, end) - offs[np.searchsorted(offs, np.arange(start, end), "right") - 1]  # bytes of the row before each
    gram = np.zeros(end - start, np.int64)
    for back in range(ORDER, -1, -1):
        b = x[ORDER - back : ORDER - back + end - start]
        gram = (gram << 8) | np.where(inside >= back, b, 0)
    return gram


class Model:
    """The trees of all languages; its size follows the training rows, not the number of languages times their contexts."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        """lang, gram, n: how often each sequence was seen in each language."""
        self.langs = langs
        self.trees = [Tree(gram[lang == k], n[lang == k]) for k in range(len(langs))]

    def code_lengths(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each row's text in each language (rows x languages)."""
        out = np.zeros((len(offs) - 1, len(self.trees)))
        for i, j in groups(offs, PIECE):
            lo, hi = int(offs[i]), int(offs[j])
            for start in range(lo, hi, PIECE):  # a text longer than a piece goes on with its context
                end = min(hi, start + PIECE)
                gram, at = np.unique(grams_of(raw, offs, start, end), return_inverse=True)
                a, b = np.clip(offs[i:j], start, end) - start, np.clip(offs[i + 1 : j + 1], start, end) - start
                total = np.zeros(end - start + 1)
                for k, tree in enumerate(self.trees):
                    np.cumsum(tree.bits(gram)[at], out=total[1:])
                    out[i:j, k] += total[b] - total[a]
        return out


def _grams(batches):
    """(lang, text) -> counts of sequences of ORDER + 1 bytes."""
    for batch in batches:
        raw, offs = text_bytes(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            for start in range(int(offs[i]), int(offs[i + 1]), PIECE):
                gram, n = np.unique(grams_of(raw, offs, start, min(int(offs[i + 1]), start + PIECE)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])


def pick(rows: DataFrame, sample: int, train_bytes: int) -> DataFrame:
    """lang, h of the rows (lang, h, size) to learn from: of each language those of the smallest hashes, at most sample and, but for the first, not more than its share of train_bytes.

    Rows are counted by language; then only hashes under a bound that some four times the sample should be under are looked at, and
    more where that was too few. So what is ranked of a language does not grow with it.
    """
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {lang: min(1.0, 4 * sample / n) for lang, n in counts.items()}
    out, asked, spark = [], sorted(counts), rows.sparkSession
    budget = max(1, train_bytes // max(1, len(counts)))
    order = Window.partitionBy("lang").orderBy(F.col("size") > budget, "h")
    while asked:
        bounds = spark.createDataFrame([(x, min((1 << 63) - 1, int(share[x] * 2.0**64) - (1 << 63))) for x in asked], "lang string, bound long")
        near = rows.join(small(bounds, MOST_BROADCAST), "lang").where(F.col("h") <= F.col("bound")).select("lang", "h", "size").distinct()
        ranked = near.withColumns({"k": F.row_number().over(order), "sum": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        taken = (F.col("k") <= sample) & ((F.col("k") == 1) | (F.col("sum") <= budget))
        ranked = store(ranked.withColumn("taken", taken), "ranked")
        # A language is done if one that fits was left over, or all its rows were looked at.
        over = {r.lang for r in ranked.where(~F.col("taken") & (F.col("size") <= budget)).select("lang").distinct().collect()}
        few = [x for x in asked if share[x] < 1 and x not in over]
        got = ranked.where("taken").select("lang", "h")
        out.append(got.where(~F.col("lang").isin(few)) if few else got)
        share |= {x: min(1.0, share[x] * 16) for x in few}
        asked = few
    picked = out[0] if out else rows
    for more in out[1:]:
        picked = picked.unionAll(more)
    return picked.select("lang", "h")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model of all values of lang, from rows of each as pick() has them: those with the smallest hash of row_id and text.

    Rows with null lang or null or empty text teach nothing, repeated rows (and rows without ids of one text) teach once.
    Where no row teaches anything the model knows no language. What comes to the driver is a number for each language and
    the distinct sequences of ORDER + 1 bytes in the picked rows, by language: train_bytes at most, but for languages whose first
    text alone is longer than their share.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(row_id, text).alias("h"), F.col(text).alias("text"))
    few = store(pick(rows.select("lang", "h", F.octet_length("text").alias("size")), sample, train_bytes), "few")
    langs = sorted(r[0] for r in few.select("lang").distinct().collect())
    if not langs:
        return Model([], *np.zeros((3, 0), np.int64))
    texts = rows.join(small(few, MOST_BROADCAST), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    got = texts.select("lang", "text").mapInArrow(frugal(_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    index = {x: k for k, x in enumerate(langs)}
    ids = np.array([index[x] for x in got.column("lang").to_pylist()], np.int64)
    return Model(langs, ids, got.column("gram").to_numpy(), got.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte"), keep: list[str] | None = None) -> DataFrame:
    """docs with the language whose code for the whole text is shortest, its probability under equal priors, and its bits a byte.

    Null texts and texts without a letter get `und`, score 0 and null bits, as do all texts if the model knows no language.
    Ties go to the first language in order.
    Row by row, no shuffle; equal texts get equal results; an empty table gives an empty table. All columns of docs (or
    those in keep) are returned; one with the name of an output column is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            k = batch.num_columns - 2
            raw, offs = text_bytes(batch.column(k))
            bits = m.code_lengths(raw, offs)
            no = ~np.array(batch.column(k + 1).to_pylist(), bool)
            if m.langs:
                best = bits.argmin(1)
                top = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(np.maximum(top[:, None] - bits, -1000)).sum(1)
            else:
                no[:], best, top, score = True, np.zeros(len(no), int), np.zeros(len(no)), np.zeros(len(no))
            name = [UNKNOWN if n else m.langs[b] for n, b in zip(no, best, strict=True)]
            rate = top / np.maximum(np.diff(offs), 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(name, pa.string()), pa.array(np.where(no, 0.0, score)), pa.array(rate, mask=no)], names=[*batch.schema.names[:k], *out])

    kept = [c for c in (keep if keep is not None else docs.columns) if c not in out]
    src = docs.select(*kept, F.col(text).alias("__li_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__li_letter"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if not f.name.startswith("__li_"))
    return src.mapInArrow(frugal(run), f"{types}{out[0]} string, {out[1]} double, {out[2]} double")
