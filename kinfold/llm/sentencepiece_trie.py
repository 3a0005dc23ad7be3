"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass over a trie of words.

Texts fall into marked words (marks, then everything up to the next mark); no piece reaches across their borders. The distinct
words are sorted, which is a depth-first walk of their trie: a word goes on from the forward states of the prefix that it
shares with the one before.

The public model is a BPE, for which the path of highest piece scores is not the library's encoding. What a forward state
holds is therefore the last piece of its prefix's BPE encoding: of all lattice edges into a position, the right one is the
only one whose piece can follow the last piece at its start, that is, no merge of a higher rank would have crossed between them.
This is one pass over the lattice like any Viterbi, with that test in place of a sum of scores, and gives exact results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
KNOWN_WORDS, KNOWN_PAIRS = 1 << 20, 1 << 20
_MODELS: dict[str, Trie] = {}


class Trie:
    def __init__(self, path: str):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        assert all(MARK not in p.lstrip(MARK) for p in self.id), "a piece reaches across words"
        # Merges go by score, best first; a single character is not a merge.
        order = sorted((i for p, i in self.id.items() if len(p) > 1), key=lambda i: -sp.get_score(i))
        self.rank = {i: k + 1 for k, i in enumerate(order)}
        self.parts: dict[int, tuple[int, int] | None] = {}
        for i in order:
            self.parts[i] = self._last_merge(self.pieces[i])
        #: Pieces that merging can make.
        self.ends = {p: i for p, i in self.id.items() if len(p) == 1 or self.parts[i] is not None}
        self.suffixes: dict = {}  # pieces from their ends, characters to nodes and "" to the piece
        for p, i in self.ends.items():
            node = self.suffixes
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # ids, 32 bits each
        self.steps = self.saved = 0

    @classmethod
    def of(cls, path: str) -> Trie:
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces that the last merge joins when text is merged by itself; null if it does not become one piece."""
        parts = [self.id.get(c, -1) for c in text]
        if -1 in parts:
            return None
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return None
            parts[at : at + 2] = [self.id[self.pieces[parts[at]] + self.pieces[parts[at + 1]]]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def follows(self, a: int, b: int) -> bool:
        """Whether pieces a and b side by side stay as they are.

        Both are taken apart again, the younger merge first; between the inner edges nothing may merge before the
        merge that took away the edge.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, parts, pieces, x, y, out = self.rank, self.parts, self.pieces, a, b, True
        # Edge pieces x (until merge number until_x hides it) and y.
        until_x = until_y = 1 << 60
        while True:
            i = self.id.get(pieces[x] + pieces[y])
            if i is not None:
                r = rank[i]
                # Of equal merges the left one goes first.
                if r < until_x and r <= until_y:
                    out = False
                    break
            rx, ry = rank.get(x, 0), rank.get(y, 0)
            if rx == 0 and ry == 0:
                break
            if rx >= ry:
                until_x, x = rx, parts[x][1]
            else:
                until_y, y = ry, parts[y][0]
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def encode_words(self, words: list[str]) -> None:
        """Fills self.words for words in sorted order."""
        before = ""
        last: list[int] = [-1]  # by prefix length: the last piece of the prefix's encoding; -2 for a character of bytes
        size: list[int] = [0]  # and its length
        suffixes, pairs, follows = self.suffixes, self.pairs, self.follows
        for word in words:
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            self.saved += k
            del last[k + 1 :], size[k + 1 :]
            for e in range(k + 1, len(word) + 1):
                node, s = suffixes, e
                while s:
                    s -= 1
                    node = node.get(word[s])
                    if node is None:
                        s = -1
                        break
                    i = node.get("")
                    if i is not None:
                        p = last[s]
                        ok = True if p < 0 else pairs.get(p << 20 | i)
                        if ok is None:
                            ok = follows(p, i)
                        if ok:
                            last.append(i)
                            size.append(e - s)
                            break
                else:
                    s = -1
                if s < 0:
                    last.append(-2)
                    size.append(1)
            self.steps += len(word) - k
            out, e = [], len(word)
            while e:
                if last[e] == -2:
                    out += [self.byte[b] for b in reversed(word[e - 1].encode())]
                else:
                    out.append(last[e])
                e -= size[e]
            self.words[word] = array("i", out[::-1]).tobytes()
            before = word

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (and the end)."""
        found = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        known = self.words
        self.encode_words(sorted({w for f in found for w in f if w not in known}))
        parts = [known[w] for f in found for w in f]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.frombuffer(b"".join(parts), np.int32)
        return ids, ends[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts of encode()'s ids: all pieces' bytes gathered into one array, less the mark in front of each text."""
        start, size = self.raw_at[ids], self.raw_at[ids + 1] - self.raw_at[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(start - to[:-1], size) + np.arange(to[-1])].tobytes()
        cut = to[at].tolist()
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)]


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """docs with n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_sha256, and with texts also ids and decoded.

    ids are the library's for the model, without begin and end; decoding gives the text back (a literal mark becomes a space).
    Null and empty texts have no ids. Row by row, no shuffle: repeated rows get equal results; ids of rows play no part; an
    empty table gives an empty table. All columns of docs (or those in keep) are returned; one with the name of an added
    column is replaced.
    """
    added = {"n_pieces": "long", "ids_crc32": "long", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if texts else {})

    def run(batches):
        trie = Trie.of(model)
        for whole in batches:
            k = whole.num_columns - 1
            size = np.cumsum([len(t.as_py() or "") for t in whole.column(k)])
            cuts = [0, *(np.flatnonzero(np.diff(size // (1 << 22))) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                ids, at = trie.encode([t or "" for t in batch.column(k).to_pylist()])
                back = trie.decode(ids, at)
                n = np.diff(at)
                crc = [zlib.crc32(ids[p:q].astype("<u4").tobytes()) for p, q in zip(at[:-1], at[1:], strict=True)]
                cols = [pa.array(n), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                if texts:
                    cols += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array([x.decode() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *cols], names=[*batch.schema.names[:k], *added])

    kept = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    src = docs.select(*kept, F.col(text).alias("__sp_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "__sp_text")
    return src.mapInArrow(run, types + ", ".join(f"{c} {t}" for c, t in added.items()))
