"""Chat formatting by columnar byte assembly, and reading it back.

A conversation is BEGIN and its turns: TURN role newline text END. Control strings inside texts get a backslash after their
first character (one more, if there are some already), so they never mark anything and can be restored. Of a batch all
segment lengths, then offsets, then scatter indices are computed in numpy; headers and contents are copied into one
preallocated buffer that is the output column's own. Rows are sorted by conversation and turn and stream through: a
conversation of any length comes out in parts and is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import text_bytes

BEGIN, TURN, END = b"<s>", b"<|turn|>", b"<|end|>\n"
#: The strings that mark something in this or in common templates.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_TAILS = "|".join(re.escape(x[1:]) for x in CONTROL)
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_RESTORE = re.compile(rf"([<\[])\\(\\*)({_TAILS})".encode())
_READ = re.compile(rb"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
ASSISTANT = b"assistant"
PART = 1 << 20


def escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, _ESCAPE, r"\1\\\2\3")


def escape_role(role: pa.Array) -> pa.Array:
    """A role stands on one line and, like a text, holds no control string."""
    return escape(pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n"))


def restore_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], restore(role))


def restore(text: bytes) -> bytes:
    return _RESTORE.sub(rb"\1\2\3", text)


def _scatter(out: np.ndarray, raw: np.ndarray, offs: np.ndarray, at: np.ndarray) -> None:
    """Copies row i of the texts to out[at[i]:]."""
    size = np.diff(offs)
    index = np.repeat(at - offs[:-1], size) + np.arange(offs[0], offs[-1])
    out[index] = raw[offs[0] : offs[-1]]


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns; where each turn begins (and the end); where its text begins, and ends."""
    role, text = escape_role(role.fill_null("")), escape(text.fill_null(""))
    (r_raw, r_offs), (t_raw, t_offs) = text_bytes(role), text_bytes(text)
    r_size, t_size, n = np.diff(r_offs), np.diff(t_offs), len(first)
    head = np.where(first, len(BEGIN), 0)
    sizes = np.stack([head, np.full(n, len(TURN)), r_size, np.ones(n, np.int64), t_size, np.full(n, len(END))], 1)
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    starts = at[:-1].reshape(n, 6)
    out = np.empty(int(at[-1]), np.uint8)
    for k, mark, rows in ((0, BEGIN, first), (1, TURN, None), (3, b"\n", None), (5, END, None)):
        where = starts[:, k] if rows is None else starts[rows, k]
        out[where[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, r_raw, r_offs, starts[:, 2])
    _scatter(out, t_raw, t_offs, starts[:, 4])
    return out, np.append(starts[:, 0], at[-1]), starts[:, 4], starts[:, 5]


def _format(batches):
    """(conv, role, text), sorted -> (conv, part, formatted, loss_start, loss_length), offsets in bytes."""
    last, part, began = None, 0, False
    for batch in batches:
        size = np.diff(text_bytes(batch.column(2))[1])
        bounds, total = [0], 0
        for i, s in enumerate(size.tolist()):  # pieces of a bounded size, or of one turn
            if total and total + s > PART:
                bounds.append(i)
                total = 0
            total += s
        bounds.append(batch.num_rows)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            conv, role, text = (batch.column(k).slice(a, b - a) for k in range(3))
            ids = conv.to_pylist()
            first = np.array([(i == 0 and (not began or ids[0] != last)) or (i > 0 and ids[i] != ids[i - 1]) for i in range(len(ids))])
            out, starts, t0, t1 = assemble(role, text, first)
            cut = np.flatnonzero(first)
            cut = cut if len(cut) and cut[0] == 0 else np.concatenate([[0], cut])
            parts = [part + 1 if k == 0 and not first[0] else 0 for k in range(len(cut))]
            ends = np.append(cut[1:], len(ids))
            offsets = np.append(starts[cut], starts[-1])
            loss = np.array([x == "assistant" for x in role.to_pylist()], bool)
            spans = [np.flatnonzero(loss[c:e]) + c for c, e in zip(cut, ends, strict=True)]
            lists = lambda f: pa.array([f(s, c) for s, c in zip(spans, cut, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(cut)), pa.array(parts, pa.int32()), pa.StringArray.from_buffers(len(cut), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)), lists(lambda s, c: (t0[s] - starts[c]).tolist()), lists(lambda s, c: (t1[s] - t0[s]).tolist())],
                names=["conv", "part", "formatted", "loss_start", "loss_length"],
            )
            last, part, began = ids[-1], parts[-1], True


def _digest(batches):
    """Parts in order -> one row a conversation, all read back from the formatted bytes."""
    state, last = None, None

    def out():
        return pa.RecordBatch.from_pylist([{"conv": last, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}], schema=schema)

    schema = None
    for batch in batches:
        schema = schema or pa.schema([("conv", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for row in batch.to_pylist():
            if row["part"] == 0:
                if state:
                    yield out()
                state, last = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], row["conv"]
            data = row["formatted"].encode()
            state[4] += len(row["formatted"])
            for m in _READ.finditer(data):
                state[0] += 1
                state[1].update(restore_role(m[1]) + b"\n" + restore(m[2]) + b"\n")
            for s, n in zip(row["loss_start"], row["loss_length"], strict=True):
                text = restore(data[s : s + n])
                state[2] += len(text.decode())
                state[3].update(text)
    if state:
        yield out()


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, part, formatted, loss_start, loss_length: each conversation's text in parts (from 0) of about PART bytes at most or of one turn, and the byte spans of assistant texts in it.

    Turns go by turn, then role, then text, nulls first; null role or text is empty. Rows with null conversation are one
    conversation. Repeated rows are turns each; empty texts are turns with an empty span. Other columns play no part.
    An empty table gives an empty table.
    """
    kind = turns.schema[conv].dataType.simpleString()
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return rows.mapInArrow(_format, f"conv {kind}, part int, formatted string, loss_start array<long>, loss_length array<long>")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """One row a conversation of what format_chats() returned, in its order (no shuffle between), read back from the bytes."""
    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.mapInArrow(_digest, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
