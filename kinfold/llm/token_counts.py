"""Token counts with a SentencePiece model; huge documents are encoded in overlapping chunks and spliced.

A cut before a space that follows another character is stable if no piece of the vocabulary holds a space mark after
another character: then no merge crosses it. `stable_cuts` proves that for the model in hand. Chunks overlap; both
encodings must agree, id by id, from the first to the last stable cut of the overlap at which both have a token boundary, and
the splice is made at the middle one of these. Where there is none (a long run without spaces), or they differ,
the overlap is widened, at last to the whole rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK, OVERLAP, HUGE = 1 << 15, 1 << 9, 1 << 16
_MODELS: dict[str, Encoder] = {}


def stable(text: str, i: int) -> bool:
    """Whether a cut before character i is one that no piece can span (a literal mark counts as a space)."""
    return text[i] == " " and text[i - 1] not in (" ", MARK)


class Encoder:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.huge = chunk, overlap, huge
        self.spliced = self.widened = 0
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        #: No piece has a mark after another character, and the model keeps texts as they are, with a mark in front.
        plain = " a  b\néﬁ "
        self.stable_cuts = all(MARK not in p.lstrip(MARK) for p in pieces) and "".join(self.sp.encode(plain, out_type=str)).startswith(MARK * 2 + "a" + MARK * 2 + "b") and self.sp.decode(self.sp.encode(plain)) == plain

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.huge or not self.stable_cuts:
            return np.array(self.sp.encode(text, num_threads=1) if text else [], np.int32)
        return self.encode_spliced(text)

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:end], and the offset in text at which each begins (last: the end). A chunk after the first begins with a space, whose mark is the one that the model puts in front."""
        part = text[start + (start > 0) : end]
        ids = np.array(self.sp.encode(part), np.int32) if part else np.zeros(0, np.int32)
        size = self.sizes[ids] if len(ids) else np.zeros(0, np.int64)
        # Bytes of a character that the vocabulary lacks are one character together: it begins at the first of them.
        if len(ids) and (size < 0).any():
            size = np.where(self.lead[ids], 1, np.where(size < 0, 0, size))
        at = start + np.concatenate([[0], np.cumsum(size)]) - (start == 0)  # at the text's start the mark stands for no character
        return ids, at

    @property
    def sizes(self) -> np.ndarray:
        """Characters of each piece, -1 for a byte."""
        if not hasattr(self, "_sizes"):
            n = self.sp.vocab_size()
            self._sizes = np.array([-1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i)) for i in range(n)], np.int64)
            self.lead = np.array([self.sp.is_byte(i) and int(self.sp.id_to_piece(i)[3:5], 16) & 0xC0 != 0x80 for i in range(n)])
        return self._sizes

    def encode_spliced(self, text: str) -> np.ndarray:
        out, start, n = [], 0, len(text)
        end = min(n, self.chunk)
        ids, at = self._chunk(text, start, end)
        while end < n:
            overlap, cut = self.overlap, -1
            while cut < 0:
                low = max(start + 1, end - overlap)
                # The next chunk begins at a stable cut; the two are compared from there on.
                begin = next((i for i in range(low, end) if stable(text, i)), -1)
                if begin > 0:
                    new_end = min(n, begin + self.chunk)
                    new_ids, new_at = self._chunk(text, begin, new_end)
                    both = np.intersect1d(at[at < end], new_at)
                    both = [int(i) for i in both if start < i < end and stable(text, int(i))]
                    part = lambda x, o: x[np.searchsorted(o, both[0], "right") - 1 : np.searchsorted(o, both[-1], "right") - 1]
                    if both and np.array_equal(part(ids, at), part(new_ids, new_at)):
                        cut = both[(len(both) - 1) // 2]
                if cut < 0:
                    self.widened += 1
                    if low == start + 1:
                        end = min(n, start + 2 * (end - start))  # no stable cut at all: a longer chunk
                        ids, at = self._chunk(text, start, end)
                        if end == n:
                            break
                    overlap *= 2
            if cut < 0:
                break
            self.spliced += 1
            # Later bytes of a character stand at the next one's offset, before the piece that begins there.
            out.append(ids[: np.searchsorted(at, cut, "right") - 1])
            k = np.searchsorted(new_at, cut, "right") - 1
            ids, at, start, end = new_ids[k:], new_at[k:], cut, new_end
        out.append(ids)
        return np.concatenate(out)


def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int = 4096, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"), keep: list[str] | None = None) -> DataFrame:
    """docs with the UTF-8 bytes and tokens of each whole text, and whether the tokens are over the limit.

    Counts are the library's for the model, without begin and end. Null and empty texts have 0 of both. Row by row, no
    shuffle: repeated rows get equal counts, ids may be null, an empty table gives an empty table. All columns of docs
    (or those in keep) are returned; one with the name of an output column is replaced.
    """

    def run(batches):
        enc = Encoder.of(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            small = [t for t in texts if t and len(t) <= enc.huge]
            sizes = iter([len(x) for x in enc.sp.encode(small, num_threads=1)] if small else [])
            n = [0 if not t else next(sizes) if len(t) <= enc.huge else len(enc.encode(t)) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            arrays = [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *out])

    kept = [c for c in (keep if keep is not None else docs.columns) if c not in out]
    src = docs.select(*kept, F.col(text).alias("__tc_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "__tc_text")
    return src.mapInArrow(run, f"{types}{out[0]} long, {out[1]} long, {out[2]} boolean")
