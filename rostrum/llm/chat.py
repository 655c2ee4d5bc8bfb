"""Chat formatting by columnar byte assembly, with a loss mask, and reading it back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that a model or a template may take for control marks; inside texts they are broken up.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"
#: Bytes of roles and texts assembled at a time; index arrays take eight times as much.
CHUNK = 4 << 20

SCHEMA = "conv_id long, part int, n_turns int, formatted string, loss_start array<long>, loss_end array<long>"


def _escaped(column: pa.Array, header: bool) -> pa.Array:
    """Backslashes doubled, control strings broken by a backslash after their first character."""
    out = pc.replace_substring(column, "\\", "\\\\")
    for mark in CONTROL:
        out = pc.replace_substring(out, mark, mark[0] + "\\" + mark[1:])
    return pc.replace_substring(out, "\n", "\\n") if header else out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data buffer of a string column and its offsets."""
    column = pa.concat_arrays([column]) if column.offset else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[: len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns formatted; the end of each turn and the span of each text in it, in bytes.

    Lengths of the five segments of a turn give cumulative offsets; constant segments are
    scattered as a matrix, variable ones byte by byte through an index.
    """
    n = len(roles)
    (role_data, role_at), (text_data, text_at) = _bytes_of(roles), _bytes_of(texts)
    open_, line, close = (np.frombuffer(x.encode(), dtype=np.uint8) for x in (OPEN, "\n", CLOSE))
    sizes = np.empty((n, 5), dtype=np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 3], sizes[:, 4] = len(open_), np.diff(role_at), 1, np.diff(text_at), len(close)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    out = np.empty(int(ends[-1, 4]) if n else 0, dtype=np.uint8)
    for k, mark in ((0, open_), (2, line), (4, close)):
        out[starts[:, k, None] + np.arange(len(mark))] = mark
    for k, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        if n == 1:
            out[starts[0, k] : ends[0, k]] = data[at[0] : at[1]]
        elif n:
            out[np.repeat(starts[:, k] - at[:-1], sizes[:, k]) + np.arange(at[0], at[-1])] = data[at[0] : at[-1]]
    return out, ends[:, 4], np.stack([starts[:, 3], ends[:, 3]], axis=1)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes, a single longer turn by itself."""
    size = np.cumsum(pc.add(pc.binary_length(batch.column(1)), pc.binary_length(batch.column(2))).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, base + CHUNK, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> SCHEMA: formatted parts of conversations with their loss spans.

    A conversation's rows lie together, parts numbered from 0; only one longer than a batch has
    several. Loss spans are code points of the part, around the escaped text of each assistant turn.
    Turns go by turn, role and text, so ties have an order; repeated rows stay; null roles and texts are
    empty; rows without a conv_id form a conversation of their own. Other columns are not read.

    Conversations stream through sorted partitions, so one of any length needs no more memory than another.
    """
    four = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn")
    ordered = four.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        last, part = object(), 0
        for chunk in (c for b in batches for c in _chunks(b)):
            ids = chunk.column(0).to_pylist()
            buffer, ends, spans = assemble(_escaped(chunk.column(1), True), _escaped(chunk.column(2), False))
            trained = pc.equal(chunk.column(1), TRAINED_ROLE).to_numpy(zero_copy_only=False)
            chars = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
            cuts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]] + [len(ids)]
            offsets = np.concatenate([[0], ends])[cuts].astype(np.int32)
            text = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets), pa.py_buffer(buffer))
            parts, loss = [], ([], [])
            for lo, hi in zip(cuts, cuts[1:]):
                part = part + 1 if ids[lo] == last and lo == 0 else 0
                last = ids[lo]
                parts.append(part)
                own = spans[lo:hi][trained[lo:hi]]
                base = chars[offsets[len(parts) - 1]]
                for side in (0, 1):
                    loss[side].append((chars[own[:, side]] - base).tolist())
            cols = [pa.array([ids[k] for k in cuts[:-1]], pa.int64()), pa.array(parts, pa.int32()), pa.array(np.diff(cuts).astype(np.int32)), text, *(pa.array(x, pa.list_(pa.int64())) for x in loss)]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, SCHEMA)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns in a formatted part."""
    out = []
    for piece in formatted.split(CLOSE)[:-1]:
        if not piece.startswith(OPEN):
            raise ValueError("not a formatted conversation")
        role, _, text = piece[len(OPEN) :].partition("\n")
        out.append((unescaped(role), unescaped(text)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted parts say, read from them alone, a row per conversation:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Takes the rows as `format_chats` leaves them, a conversation's parts together and in order.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def close():
            conv, n, turns, loss_n, loss, chars = state
            done.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, part, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5))):
                if part == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in turns_of(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(starts, ends):
                    own = unescaped(text[s:e])
                    state[3] += len(own)
                    state[4].update(own.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if done:
                yield flush()
        if state:
            close()
            yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
