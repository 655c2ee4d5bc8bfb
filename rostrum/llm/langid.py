"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1_024
SEED = 20_011
#: Languages that prototypes are held for; each is DIMENSIONS numbers on the driver and in the tasks.
MAX_LANGUAGES = 2_000
#: N-gram vectors that a task remembers (a byte per dimension each).
REMEMBERED = 65_536
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"
_SPACE = 32


def _letters() -> np.ndarray:
    """Lower-cased code point of each letter of the basic plane; a blank for anything else."""
    table = np.full(1 << 16, _SPACE, dtype=np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of the whole text, packed, and their counts.

    Case is folded; runs of anything but letters are one blank, as are both ends. A text without
    letters has none. Long texts are counted block by block.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    found: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    carry = np.array([_SPACE], dtype=np.uint32)
    seen = False
    for start in range(0, len(text) + 1, BLOCK_CHARS):
        part = np.frombuffer(text[start : start + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        high = part >= 1 << 16
        codes = _TABLE[0][np.where(high, _SPACE, part)]
        if high.any():
            codes[high] = [c if chr(c).isalpha() else _SPACE for c in part[high].tolist()]
        seen = seen or bool((codes != _SPACE).any())
        line = np.concatenate([carry, codes, np.array([_SPACE] if start + BLOCK_CHARS > len(text) else [], np.uint32)])
        keep = np.ones(len(line), dtype=bool)
        keep[1:] = (line[1:] != _SPACE) | (line[:-1] != _SPACE)
        line = line[keep].astype(np.uint64)
        if len(line) >= 3:
            k, n = np.unique((line[:-2] << np.uint64(42)) | (line[1:-1] << np.uint64(21)) | line[2:], return_counts=True)
            found.append(k)
            counts.append(n)
        carry = line[-2:].astype(np.uint32)
    if not seen or not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0], counts[0]
    keys, back = np.unique(np.concatenate(found), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


class Space:
    """Random letter vectors, and n-gram vectors bound from them."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.zeros((1_024, self.dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        """A vector of random signs that depends on the letter alone."""
        v = self.letters.get(code)
        if v is None:
            bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, self.dimensions)
            v = self.letters[code] = (2 * bits - 1).astype(np.int8)
        return v

    def bound(self, key: int) -> np.ndarray:
        """The letters of a trigram, each rotated by its place, multiplied."""
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigram vectors, each as often as it occurs; exact."""
        total = np.zeros(self.dimensions, dtype=np.float64)
        for s in range(0, len(keys), 4_096):
            part = keys[s : s + 4_096].tolist()
            if len(self.place) + len(part) > REMEMBERED:
                self.clear()
            for k in part:
                if k not in self.place:
                    at = self.place[k] = len(self.place)
                    if at == len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[at] = self.bound(k)
            at = np.fromiter((self.place[k] for k in part), np.int64, len(part))
            n = counts[s : s + 4_096]
            exact = np.float32 if n.sum() < 1 << 24 else np.float64
            total += n.astype(exact) @ self.rows[at].astype(exact)
        return total


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of all trigrams of all its documents.

    Tasks add up integers, which Spark sums by language and dimension, so the result is the same
    whatever task ran where. Null languages and texts teach nothing.
    """
    two = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]):
        space = Space()
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            parts: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                parts.setdefault(lang, []).append(trigrams(text.as_py()))
            for lang, rows in parts.items():
                keys, back = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([c for _, c in rows]), minlength=len(keys)).astype(np.int64)
                sums[lang] = space.bundle(keys, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    spread = two.mapInArrow(run, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("at", "x"))
    summed = spread.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = summed.limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for lang, at, x in rows:
        out.setdefault(lang, np.zeros(DIMENSIONS))[at] = x
    return {k: out[k] for k in sorted(out) if out[k].any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the prototype of largest cosine, and that cosine (0 if negative).

    Ties go to the first language by name. `und` and 0 for null texts, texts without letters, and when
    nothing was learned. One scan without a shuffle; prototypes, bounded by MAX_LANGUAGES, are broadcast.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, DIMENSIONS))
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]):
        space = Space()
        known, table = shared.value
        for b in batches:
            langs, scores = [], []
            for text in b.column(1):
                keys, counts = trigrams(text.as_py() or "")
                own = space.bundle(keys, counts) if len(keys) and known else np.zeros(1)
                size = np.linalg.norm(own)
                if size == 0:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = table @ own / size
                best = int(cosine.argmax())
                langs.append(known[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, lang_pred string, score double")
