"""Sum-of-squares packing of token sequences into fixed-length bins."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import slices, staged

CAPACITY = 2_048
END_ID = 0
#: Pieces that are packed together; one such group is a few megabytes.
GROUP = 32_768
#: Segments whose ids a Python worker remembers, twice over; REMEMBERED_BYTES bounds them as well.
REMEMBERED = 340_000
#: Bytes that remembered segments and their ids may take in a Python worker, twice over, and text encoded at a time.
REMEMBERED_BYTES = 64 << 20
CHUNK = 2 << 20
#: Segments that are encoded in one call.
TOGETHER = 16_384

#: Byte-level vocabularies write printable bytes as themselves and the others as the code points from 256 on, in order.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_MAPPED = dict(zip([b for b in range(256) if b not in _PRINTED], range(256, 512)))
_MAPPED_BLANK = chr(_MAPPED[0x20])
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
#: White space beyond ASCII and separators that tokenizers may take for it; texts with any are encoded whole.
_ODD = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def segments(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where segments begin in the bytes of texts that lie one behind the other; `rows` are the texts' beginnings.

    Byte-level BPE takes a word with the blank before it, the white space before that as one piece, and a last
    white-space character that is no blank by itself. Letters end before ASCII characters of any other kind.
    Nothing is joined across these borders.
    """
    n = len(data)
    blank = _BLANK[data]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    ahead = np.append(blank[1:], True) | first[1:]  # what follows is white space, or the text ends
    cut = first[:-1] | (blank & ~ahead)  # a text begins; the white space that stands before a word
    cut[1:] |= blank[1:] & ~blank[:-1]  # white space begins
    cut[1:] |= cut[:-1] & blank[:-1] & ~blank[1:] & (data[:-1] != 0x20)  # the word behind a line end or a tab
    letter = _LETTER[data]
    lead, last = data[:-1], data[1:]  # the characters from U+00C0 to U+027F have two bytes, and all but two are letters
    letter[1:] |= (lead >= 0xC3) & (lead <= 0xC9) & ((lead != 0xC3) | ((last != 0x97) & (last != 0xB7)))
    cut[1:] |= letter[:-1] & ~letter[1:] & ~blank[1:] & (data[1:] < 0x80)
    return np.flatnonzero(cut)


class Encoder(dict):
    """Ids of texts as little-endian 32-bit numbers, by way of their `segments`.

    The different segments of a chunk are found by dictionary encoding, each is encoded once and remembered, and
    the texts' ids are gathered from them by offsets. Texts with special tokens or white space
    beyond ASCII are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def lookup(self, keys: list[bytes]) -> list[bytes]:
        """The ids of each segment. Those not remembered are encoded many at a time."""
        found = list(map(self.get, keys))
        for lo in range(0, len(keys), TOGETHER):
            missing = [i for i in range(lo, min(lo + TOGETHER, len(keys))) if found[i] is None]
            for i in missing:
                found[i] = self.older.get(keys[i]) or self._letters(keys[i].decode())
            unknown = [i for i in missing if found[i] is None]
            coded = self.tokenizer.encode_batch_fast([keys[i].decode() for i in unknown], add_special_tokens=False)
            for i, e in zip(unknown, coded):
                found[i] = array("I", e.ids).tobytes()
            for i in missing:
                self._remember(keys[i], found[i])
        return found

    def _letters(self, text: str) -> bytes | None:
        """The ids of letters with a blank before them, or without, which the tokenizer takes as one piece; None for anything else."""
        blank = text[:1] == " "
        if not (text[1:] if blank else text).isalpha():
            return None
        if text.isascii():
            text = _MAPPED_BLANK + text[1:] if blank else text
        else:
            text = text.encode().decode("latin-1").translate(_MAPPED)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _remember(self, key: bytes, found: bytes) -> None:
        cost = len(key) + len(found) + 180
        if cost > REMEMBERED_BYTES // 8:
            return
        if len(self) >= REMEMBERED or self.size + cost > REMEMBERED_BYTES:
            self.older = dict(self)
            self.clear()
            self.size = 0
        self[key] = found
        self.size += cost

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has. No text is null."""
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        _, offsets, buffer = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[: len(texts) + 1].astype(np.int64)
        data = np.frombuffer(buffer, np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        filled = np.flatnonzero(np.diff(at))
        cuts = segments(data, at[filled])
        parts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), buffer])
        row = np.searchsorted(at[1:], cuts, side="right")
        if odd.any():
            keep = ~odd[row]
            parts, row = parts.filter(pa.array(keep)), row[keep]
        coded = parts.dictionary_encode()
        each = self.lookup(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        size = np.fromiter(map(len, each), np.int32, len(each)) // 4  # no text has as many ids as 32 bits can count
        flat, start = np.frombuffer(b"".join(each), "<u4"), np.cumsum(size, dtype=np.int32) - size
        n = size[index]
        total = np.cumsum(n, dtype=np.int32)
        place = np.repeat(start[index] - (total - n), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = flat[place]
        counts = np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)
        if odd.any():
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd).tolist():
                pieces[k] = np.frombuffer(self.whole(texts[k].as_py()), "<u4")
                counts[k] = len(pieces[k])
            ids = np.concatenate(pieces)
        return ids, counts

    def ids(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def _encoder(path: str) -> Encoder:
    """The worker's encoder, kept between its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has its own core and no more
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_rostrum_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of `docs`, in one scan.

    A document is its ids and then END_ID; a null text is empty. One longer than `capacity` is
    cut into full pieces after a first piece that holds the remainder, if there is one.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]):
        pa.default_memory_pool().release_unused()  # what tasks of other stages left in this worker
        encode = _encoder(path).encode
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            for first, texts in slices(pc.fill_null(batch.column(1), ""), CHUNK):
                ids, counts = encode(texts)
                n = counts + 1
                ends = np.cumsum(n)
                out = np.full(int(ends[-1]), END_ID, "<u4")
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                # A document's pieces: the remainder first, if there is one, then full ones.
                pieces_of = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces_of)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
                head = np.where(n % capacity == 0, capacity, n % capacity)[doc]
                start = np.where(number == 0, 0, head + (number - 1) * capacity)
                length = np.where(number == 0, head, capacity)
                at = 4 * ((ends - n)[doc] + start)
                view = memoryview(out).cast("B")
                sums = [zlib.crc32(view[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist())]
                cols = [batch.column(0).take(pa.array(first + doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)
            pa.default_memory_pool().release_unused()

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the given order.

    An item goes where the sum over gaps of the squared number of open bins with that gap
    becomes smallest: into a bin of some gap, or into a new one. Full bins have no gap and do not
    count. Ties prefer the tightest open bin, the one opened last.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        gap = -1
        if size < capacity:
            now = counts[size:capacity]
            # From gap g to g - size the sum changes by 2 (N(g - size) - N(g) + 1); a filled bin only leaves.
            change = np.where(now > 0, 2 * (counts[: capacity - size] - now + 1), far)
            if now[0]:
                change[0] = 1 - 2 * now[0]
            best = int(change.argmin())
            if change[best] <= 2 * counts[capacity - size] + 1:
                gap = best + size
        if gap < 0:
            bins[k], offsets[k] = made, 0
            made += 1
            gap = capacity
        else:
            bins[k], offsets[k] = open_bins[gap].pop(), capacity - gap
            counts[gap] -= 1
        if gap > size:
            open_bins[gap - size].append(int(bins[k]))
            counts[gap - size] += 1
    return bins, offsets


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces`.

    Pieces are dealt by hash into groups of about `group`, so no group grows with the input or
    with a hot document; inside one, longer pieces come first. Full pieces need no packing but
    stay in their group. Each group leaves a few bins part-empty, which at this size is
    well under one in a hundred.
    """
    found = staged(found, "pieces")
    groups = max(1, -(-found.count() // group))
    # Repeated rows hash alike: a third of all rows may be one document's copies, so rows of a
    # key are spread by their place in the file as well, which a repeated task reads again.
    salt = F.xxhash64("doc_id", "piece", "ids_crc32", "_metadata.file_path", "_metadata.row_index")
    dealt = found.select("*", F.pmod(salt, F.lit(groups)).alias("_group"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("_group").applyInPandas(run, f"{_ddl(found)}, sequence_id long, offset long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their places: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Rows that repeat are packed each for itself; a null doc_id is carried along. Other columns
    are not read. An empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)
