"""Removal of passages that repeat across documents: a count-min prefilter, then exact groups of windows."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged

#: Words of a window, and of the stretch inside it that stands for it in the sketch.
WINDOW, ANCHOR = 50, 20
#: Bytes of text that are hashed at a time, and that a chunk of documents has.
SLICE, CHUNK = 1 << 19, 2 << 20
#: Sketch: rows, cells of a segment (as a power of two), the most cells of a row, anchors a task sketches at a time.
ROWS, SEGMENT_BITS, MAX_BITS, HELD = 2, 20, 29, 4_000_000
#: Cells wished for per byte of text: eight for each anchor, of which there is about one in 16 words.
CELLS_PER_BYTE = 1 / 12

_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_KEPT: dict = {}


def _mixed(x: np.ndarray, lane: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[lane]
    return x ^ (x >> np.uint64(29))


def _of_lane(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of the lane's multiplier and of its inverse modulo 2^64."""
    if lane not in _KEPT:
        values = np.random.default_rng(50 + lane).integers(0, 1 << 64, 256, dtype=np.uint64)
        steps = np.full(2 * SLICE, _MULT[lane], np.uint64)
        back = np.full(2 * SLICE, np.uint64(pow(int(_MULT[lane]), -1, 1 << 64)), np.uint64)
        steps[0] = back[0] = 1
        _KEPT[lane] = values, np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _KEPT[lane]


def _slices(space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE bytes that end with white space or the text; a longer word is one by itself."""
    at, n = 0, len(space)
    while at < n:
        end = min(n, at + SLICE)
        while end < n and not space[end - 1]:
            blanks = np.flatnonzero(space[at:end])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # no word ends here: go on to where one does
                more = np.flatnonzero(space[end : end + SLICE])
                end = end + int(more[0]) + 1 if len(more) else min(n, end + SLICE)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, lanes: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each word of the UTF-8 bytes begins, and for each lane a 64-bit hash of it."""
    space = _SPACE[data]
    begin, found = [], [[] for _ in lanes]
    for lo, hi in _slices(space):
        here = space[lo:hi]
        edge = np.diff(np.concatenate([[True], here, [True]]).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        begin.append(s + lo)
        long = np.flatnonzero(e - s > SLICE)
        for out, lane in zip(found, lanes):
            values, steps, back = _of_lane(lane)
            if hi - lo <= 2 * SLICE:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data[lo:hi]] * steps[: hi - lo], dtype=np.uint64)])
                h = _mixed((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64), lane)
            else:  # one word longer than the tables of powers
                h = np.zeros(len(s), np.uint64)
            for k in long:
                h[k] = xxhash.xxh64_intdigest(data[lo + s[k] : lo + e[k]].tobytes(), lane)
            out.append(h)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(begin, np.int64), [join(x, np.uint64) for x in found]


def rolling(h: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash of every `size` consecutive words, from hashes of twice as many each time."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n, out, done = len(h) - size + 1, np.zeros(len(h) - size + 1, np.uint64), 0
    part, width, factor = h, 1, int(_MULT[lane])
    while True:
        if size & width:
            out = out * np.uint64(factor) + part[done : done + n]
            done += width
        if width * 2 > size:
            return out
        part = part[:-width] * np.uint64(factor) + part[width:]
        width, factor = width * 2, factor * factor % (1 << 64)


def _minima(x: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every `span` consecutive numbers."""
    width = 1
    while width * 2 <= span:
        x, width = np.minimum(x[:-width], x[width:]), width * 2
    return np.minimum(x[: len(x) - (span - width)], x[span - width :]) if span > width else x


class Chunk:
    """The words of some texts, their windows, and blocks of neighbouring windows that share an anchor.

    A window's anchor is the smallest hash among its stretches of ANCHOR words, so equal windows have equal
    anchors, and inside a passage that two documents share the blocks are the same in both.
    """

    def __init__(self, texts: list[bytes], lanes: tuple[int, ...] = (0,)):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        begin, self.hashes = word_hashes(data, lanes)
        self.n_words = np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))
        self.first_word = np.cumsum(self.n_words) - self.n_words
        text_of = np.repeat(np.arange(len(texts)), self.n_words)
        h = self.hashes[0]
        self.begin = self.n = self.text = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if len(h) < WINDOW:
            return
        anchor = _minima(_mixed(rolling(h, ANCHOR)), WINDOW - ANCHOR + 1)
        whole = text_of[: len(anchor)] == text_of[WINDOW - 1 :]
        fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text_of[1 : len(anchor)] != text_of[: len(anchor) - 1])]) & whole
        fresh |= whole & ~np.concatenate([[False], whole[:-1]])
        cut = np.flatnonzero(fresh)
        # A block ends where the next begins or where windows leave its text.
        upto = np.minimum(np.append(cut[1:], len(anchor)), (self.first_word + self.n_words)[text_of[cut]] - WINDOW + 1)
        self.begin, self.n, self.text, self.anchor = cut, upto - cut, text_of[cut], anchor[cut]

    def block_hashes(self, lane: int, of: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the windows of each listed block, in order."""
        out = np.zeros(len(of), np.uint64)
        if len(of):
            w = _mixed(rolling(self.hashes[lane], WINDOW, lane), lane)
            steps = np.full(int(self.n[of].max()), _MULT[1 - lane], np.uint64)
            steps[0] = 1
            power = np.cumprod(steps, dtype=np.uint64)
            inside = np.arange(self.n[of].sum()) - np.repeat(np.cumsum(self.n[of]) - self.n[of], self.n[of])
            terms = w[np.repeat(self.begin[of], self.n[of]) + inside] * power[inside]
            out = np.add.reduceat(terms, np.cumsum(self.n[of]) - self.n[of], dtype=np.uint64)
        return _mixed(out + self.n[of].astype(np.uint64), lane)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about CHUNK bytes; a single longer text by itself."""
    at, texts, size = 0, [], 0
    for k, value in enumerate(batch.column(column)):
        text = (value.as_py() or "").encode("utf-8", "surrogatepass")
        if texts and size + len(text) > CHUNK:
            yield at, texts
            at, texts, size = k, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield at, texts


def _cell(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return _mixed(anchor * _MIX[row] + np.uint64(row), row) >> np.uint64(64 - bits)


def sketch(docs: DataFrame, bits: int) -> list[np.ndarray]:
    """For each row of a count-min sketch of 2^bits cells, a bit for every cell that counts two documents or more.

    Each task sketches the anchors of its documents, once a document, and passes on the cells it used with a
    count of one or more; segments of the sketches are added up all over the cluster.
    """
    low = min(bits, SEGMENT_BITS)
    per_row = 1 << (bits - low)

    def partial(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def flush():
            anchors = np.concatenate(held)
            segments, parts = [], []
            for row in range(ROWS):
                cells, count = np.unique(_cell(anchors, row, bits), return_counts=True)
                packed = (cells & np.uint64((1 << low) - 1)).astype(np.uint32) | ((count > 1).astype(np.uint32) << np.uint32(31))
                segment = (cells >> np.uint64(low)).astype(np.int64)
                for cut in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(segment)) + 1):
                    segments.append(row * per_row + int(segment[cut[0]]))
                    parts.append(packed[cut].tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(parts, pa.binary())], ["segment", "cells"])

        for batch in batches:
            for _, texts in _chunks(batch, 1):
                chunk = Chunk(texts)
                if len(chunk.anchor):
                    order = np.lexsort((chunk.anchor, chunk.text))
                    text, anchor = chunk.text[order], chunk.anchor[order]
                    once = anchor[np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])]
                    held.append(once)
                    size += len(once)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]):
        now, dense = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(dense > 1).tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, dense = segment, np.zeros(1 << low, np.uint8)
                packed = np.frombuffer(cells.as_buffer(), np.uint32)
                at = packed & np.uint32((1 << 31) - 1)
                dense[at] = np.minimum(dense[at] + 1 + (packed >> np.uint32(31)), 2)
        if now is not None:
            yield done()

    parts = docs.mapInArrow(partial, "segment long, cells binary")
    sums = parts.repartition(F.col("segment")).sortWithinPartitions("segment").mapInArrow(merged, "segment long, bits binary")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    size = (1 << low) // 8
    for segment, found in sums.collect():
        row, part = divmod(segment, per_row)
        out[row][part * size : (part + 1) * size] = np.frombuffer(found, np.uint8)
    return out


def _estimated_repeated(sketched: list[np.ndarray], bits: int, anchor: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchor), bool)
    for row, held in enumerate(sketched):
        cell = _cell(anchor, row, bits)
        out &= (held[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


_BLOCK = ["at", "n", "b1", "b2", "a"]
_MARKED = "doc_id long, k long, n_words long, whole string, joined string, text string, " + ", ".join(f"{c} array<long>" for c in _BLOCK)


def _marked(docs: DataFrame, sketched: list[np.ndarray] | None, bits: int, with_text: bool) -> DataFrame:
    """_MARKED: every row with its blocks estimated repeated (all blocks without a sketch) and its text if there are any, else its words' digest."""
    shared = docs.sparkSession.sparkContext.broadcast(sketched)

    def run(batches: Iterator[pa.RecordBatch]):
        held = shared.value
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for at, texts in _chunks(batch, 1):
                chunk = Chunk(texts, (0, 1))
                own = ids.slice(at, len(texts))
                known = own.is_valid().to_numpy(zero_copy_only=False)
                pick = np.flatnonzero(known[chunk.text] & (True if held is None else _estimated_repeated(held, bits, chunk.anchor)))
                text_of = chunk.text[pick]
                counts = np.bincount(text_of, minlength=len(texts))
                columns = [chunk.begin[pick] - chunk.first_word[text_of], chunk.n[pick], chunk.block_hashes(0, pick), chunk.block_hashes(1, pick), chunk.anchor[pick]]
                joined = [None if c else b" ".join(t.split()) for t, c in zip(texts, counts)]
                whole = [None if j is None else hashlib.sha256(j).hexdigest() for j in joined]
                said = [j.decode("utf-8", "surrogatepass") if with_text and j is not None else None for j in joined]
                kept = pa.array([t.decode("utf-8", "surrogatepass") if c else None for t, c in zip(texts, counts)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [own, keys.slice(at, len(texts)), pa.array(chunk.n_words, pa.int64()), pa.array(whole, pa.string()), pa.array(said, pa.string()), kept, *(_lists(c, counts) for c in columns)],
                    ["doc_id", "k", "n_words", "whole", "joined", "text", *_BLOCK])

    return docs.mapInArrow(run, _MARKED)


def _least(rows: DataFrame, key: list[str], out: str) -> DataFrame:
    """The smallest document of every key that two documents have. Written, so that the join with it reads two plain
    shuffles and the partition of a common key can be split among tasks."""
    ends = rows.groupBy(*key).agg(F.min("doc_id").alias(out), F.max("doc_id").alias("_hi"))
    return staged(ends.filter(F.col(out) < F.col("_hi")).drop("_hi"), "least")


def _repeated_by_count(blocks: DataFrame) -> DataFrame:
    """The blocks whose anchor is in two documents or more: what the sketch says, by a shuffle, for texts beyond its size."""
    return blocks.join(_least(blocks, ["a"], "lo").select("a"), "a", "left_semi")


def _verdicts(blocks: DataFrame) -> DataFrame:
    """(doc_id, k, blocks of (at, n, gone)): blocks that a smaller document has as a whole are gone."""
    first = _least(blocks, ["b1", "b2"], "first")
    gone = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("gone")
    judged = blocks.join(first, ["b1", "b2"], "left").select("doc_id", "k", F.struct("at", "n", gone).alias("block"))
    return judged.groupBy("doc_id", "k").agg(F.collect_set("block").alias("blocks"))


def _spans(blocks: pa.ListScalar, gone: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of a document's blocks of one verdict."""
    if not blocks.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, n, verdict = (blocks.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "gone"))
    return at[verdict == gone], n[verdict == gone]


_WINDOWS = "doc_id long, k long, at array<long>, w1 array<long>, w2 array<long>"


def _open_windows(texts: DataFrame) -> DataFrame:
    """_WINDOWS: the windows of blocks that are the first of their kind, which may still begin in a smaller document inside other blocks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, keys, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for at, texts in _chunks(batch, 2):
                spans = [_spans(blocks[at + i], False) for i in range(len(texts))]
                hashes = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8), (0, 1))
                ends = np.searchsorted(hashes[0], np.cumsum([len(t) + 1 for t in texts]))
                w = [_mixed(rolling(h, WINDOW, lane), lane) for lane, h in enumerate(hashes[1])]
                place = [np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()) for a, n in spans]
                counts = np.array([len(p) for p in place])
                every = np.concatenate(place)
                on = every + np.repeat(np.concatenate([[0], ends[:-1]]), counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + len(texts)], pa.int64()), pa.array(keys[at : at + len(texts)], pa.int64()), _lists(every, counts), _lists(w[0][on], counts), _lists(w[1][on], counts)],
                    ["doc_id", "k", "at", "w1", "w2"])

    return texts.mapInArrow(run, _WINDOWS)


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, k, places): windows that also begin in a smaller document. The least document of a window is an aggregate, so common windows meet nowhere as a group."""
    each = windows.select("doc_id", "k", F.explode(F.arrays_zip("at", "w1", "w2")).alias("w")).select("doc_id", "k", "w.at", "w.w1", "w.w2")
    return each.join(_least(each, ["w1", "w2"], "lo"), ["w1", "w2"]).filter("doc_id > lo").groupBy("doc_id", "k").agg(F.collect_set("at").alias("places"))


_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(found: DataFrame, with_text: bool) -> DataFrame:
    """(doc_id, text, blocks, places) -> _DONE."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for doc, text, blocks, places in zip(*(batch.column(c) for c in range(4))):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                covered = np.zeros(len(words) + 1, np.int64)
                at, n = _spans(blocks, True)
                single = places.values.to_numpy() if places.is_valid else at[:0]
                np.add.at(covered, np.concatenate([at, single]), 1)
                np.add.at(covered, np.concatenate([at + n, single + 1]) + WINDOW - 1, -1)
                stays = np.cumsum(covered[:-1]) == 0
                kept = b" ".join(itertools.compress(words, stays))
                rows.append((doc.as_py(), len(words), int((~stays).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split(" ")[0] for x in _DONE.split(", ")])

    return found.mapInArrow(run, _DONE)


def remove_repeats(docs: DataFrame, with_text: bool = False, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, on demand, kept_text) for every row of `docs`.

    A word goes if it is covered by a window of 50 words that also begins in a document with a smaller id. Words are
    runs without ASCII white space; kept ones are joined by single blanks. Windows are judged on the input.

    First pass: tasks' count-min sketches of the windows' anchors, added up; what they overestimate is never
    too little. Second pass: only windows estimated repeated are grouped exactly, by 128 bits of their words.
    Equal blocks of windows are settled first, one row a block, and only the windows of blocks that are the
    first of their kind one by one. The sketch is broadcast and has 2^max_bits cells a row at most; for texts
    that would overfill it the anchors are counted by a shuffle.

    Null texts have no words. Rows without an id stay whole and take nothing from others; rows that share an id
    do not affect each other. Other columns are not read. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = int(np.clip(np.ceil(np.log2(max(1.0, size * CELLS_PER_BYTE))), 16, max_bits))
    sketched = sketch(rows, bits) if size * CELLS_PER_BYTE <= 4 << max_bits else None
    marked = staged(_marked(rows, sketched, bits, with_text), "marked")
    touched = marked.filter("text is not null")
    blocks = touched.select("doc_id", "k", F.explode(F.arrays_zip(*_BLOCK)).alias("b")).select("doc_id", "k", *(f"b.{c}" for c in _BLOCK))
    verdicts = staged(_verdicts(blocks if sketched else _repeated_by_count(blocks)), "verdicts")
    texts = touched.select("doc_id", "k", "text")
    windows = staged(_open_windows(texts.join(verdicts.filter(F.exists("blocks", lambda b: ~b["gone"])), ["doc_id", "k"])), "windows")
    found = texts.join(verdicts, ["doc_id", "k"], "left").join(_repeated_windows(windows), ["doc_id", "k"], "left")
    done = _cut(found.select("doc_id", "text", "blocks", "places"), with_text)
    plain = marked.filter("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256"), F.col("joined").alias("kept_text"))
    out = plain.union(done)
    return out if with_text else out.drop("kept_text")
