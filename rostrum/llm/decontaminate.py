"""Benchmark passages in documents: q-gram lemma filter on diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import forget_encoders, slices

#: Letters of a q-gram; of a benchmark window, of which one begins at every letter; edits allowed per letter.
Q, WINDOW, EDIT_RATE = 10, 100, 0.08
#: Benchmark text that is indexed, collected and broadcast at a time; larger benchmarks take several passes.
BLOCK_CHARS = 2_000_000
#: Text that is looked at at a time.
CHUNK_CHARS = 1 << 20
#: Pairs of a gram's places in text and item that are held at a time, and diagonals of a very repetitive text that are.
MOST_PAIRS, STRETCH = 2_000_000, 2_520
#: Candidates that are looked at for alignment at a time.
ALIGNED = 8_192
SIEVE_BITS = 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _letters() -> np.ndarray:
    """Lower-cased code point of each letter or digit of the basic plane, 0 for anything else."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


_TABLE: list[np.ndarray] = []


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of `text`, lower-cased, as numbers, and their places. White space and
    punctuation do not count. Characters beyond the basic plane are folded into its private area."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) and points.max() >= 1 << 16:
        high = points >= 1 << 16
        codes = _TABLE[0][np.where(high, 0, points)]
        codes[high] = 0xE000 + points[high] % 0x1800
    else:
        codes = _TABLE[0][points]
    at = np.flatnonzero(codes)
    return codes[at], at


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q letters from each place on. Each letter is narrowed to a byte first:
    that can only add false hits, which alignment removes."""
    narrow = ((codes >> np.uint16(8)) * np.uint16(31) + codes).astype(np.uint8)
    n = len(narrow) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = np.ndarray((n,), "<u8", np.ascontiguousarray(narrow), 0, (1,))
    high = np.ndarray((n,), "<u2", narrow, 8, (1,)).astype(np.uint64)
    return (low * MIX[0]) ^ (high * MIX[1])


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * MIX[2]) >> np.uint64(64 - SIEVE_BITS)


@dataclass
class Index:
    """Benchmark items, a window from every letter of them on, and where each q-gram stands in an item."""

    names: list  # item_id of each item
    letters: np.ndarray  # of all items, one behind the other
    begin: np.ndarray  # where each item's letters begin
    size: np.ndarray  # letters of each item's windows
    n_windows: np.ndarray  # windows of each item
    first_window: np.ndarray  # number of each item's first window
    allowed: np.ndarray  # edits allowed in each item's windows
    need: np.ndarray  # q-grams a region must share with one of them
    longest: int  # letters of the longest item
    hashes: np.ndarray
    first: np.ndarray
    item_of: np.ndarray
    place_of: np.ndarray
    sieve: np.ndarray
    sums: tuple[np.ndarray, np.ndarray]  # for the hash of any stretch of the letters

    @property
    def items(self) -> np.ndarray:
        """Item number of each window."""
        return np.repeat(np.arange(len(self.names)), self.n_windows)

    @property
    def budget(self) -> np.ndarray:
        """Edits allowed in each window."""
        return np.repeat(self.allowed, self.n_windows)

    @property
    def windows(self) -> list[np.ndarray]:
        at = np.arange(self.n_windows.sum()) - np.repeat(self.first_window - self.begin, self.n_windows)
        return [self.letters[a : a + n] for a, n in zip(at, np.repeat(self.size, self.n_windows))]


def build(rows: list[tuple]) -> Index:
    """Index of (item_id, text) rows. Items of fewer than Q letters and digits cannot be told from
    chance and have no window."""
    names, texts = [], []
    for name, text in rows:
        codes = folded(text or "")[0]
        if len(codes) >= Q:
            names.append(name)
            texts.append(codes)
    length = np.array([len(c) for c in texts], dtype=np.int64)
    size = np.minimum(length, WINDOW)
    n_windows = length - size + 1
    budget = (size * EDIT_RATE).astype(np.int64)
    # k edits destroy k * Q of the window's q-grams at most.
    budget = np.minimum(budget, np.maximum(0, (size - Q) // Q))
    need = size - Q + 1 - budget * Q
    each = [grams(c) for c in texts]
    flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
    item_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(e) for e in each])
    place_of = np.concatenate([np.arange(len(e)) for e in each]) if each else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
    sieve[_slot(hashes)] = True
    return Index(
        names,
        np.concatenate(texts) if texts else np.zeros(0, np.uint16),
        np.cumsum(length) - length,
        size,
        n_windows,
        np.cumsum(n_windows) - n_windows,
        budget,
        need,
        int(length.max(initial=0)),
        hashes,
        np.append(first, len(flat)),
        item_of[order],
        place_of[order],
        sieve,
        _prefix_hash(np.concatenate(texts) if texts else np.zeros(0, np.uint16)),
    )


def _align(pattern: np.ndarray, text: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best placement of each window, a row of `pattern`, on the diagonals low .. low + width - 1.

    Dynamic programming over the band, all candidates of one window length at a time: a row per
    letter of the window, a column per diagonal. Letters of the text before and behind are free.
    """
    size = pattern.shape[1]
    steps = np.arange(width)
    cost = np.zeros((len(pattern), width), dtype=np.int32)
    origin = np.tile(low[:, None] + steps, 1)
    far = np.int32(1 << 20)
    for i in range(size):
        at = low[:, None] + steps + i
        inside = (at >= 0) & (at < len(text))
        letter = text[np.clip(at, 0, len(text) - 1)]
        match = np.where(inside, cost + (letter != pattern[:, i, None]), far)
        skip = np.full_like(cost, far)  # a letter of the window is missing in the text
        skip[:, :-1] = cost[:, 1:] + 1
        take = skip < match
        now = np.where(take, skip, match).astype(np.int32)
        source = np.where(take, np.roll(origin, -1, axis=1), origin)
        # A letter of the text that is not in the window: from the diagonal before, one edit each.
        flat = now - steps.astype(np.int32)
        best = np.minimum.accumulate(flat, axis=1)
        where = np.maximum.accumulate(np.where(flat == best, steps, 0), axis=1)
        cost = best + steps.astype(np.int32)
        origin = np.take_along_axis(source, where, axis=1)
    col = cost.argmin(axis=1)
    pick = np.arange(len(pattern))
    return cost[pick, col], origin[pick, col], low + col + size


def search(index: Index, text: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, window, edits, start, end) wherever a window lies in a text within its edit budget.
    `bounds` are the places in `text` where the texts begin, each with WINDOW letters of padding before and behind."""
    h = grams(text)
    if not len(h) or not len(index.hashes):
        return []
    hit = np.flatnonzero(index.sieve[_slot(h)])
    at = np.searchsorted(index.hashes, h[hit])
    at[at == len(index.hashes)] = 0
    real = index.hashes[at] == h[hit]
    hit, at = hit[real], at[real]
    if not len(hit):
        return []
    # Diagonals count from the text's own beginning, so what is found does not depend on the texts before it.
    own = np.maximum(np.searchsorted(bounds, hit, side="right") - 1, 0)
    times = index.first[at + 1] - index.first[at]
    texts = _Hashed(text, bounds, _prefix_hash(text))
    parts = []
    for lo, hi in _portions(own, times):
        if times[lo:hi].sum() <= MOST_PAIRS:
            parts.append(_placed(index, texts, hit[lo:hi], at[lo:hi], own[lo:hi]))
        else:
            parts += _by_stretches(index, texts, hit[lo:hi], at[lo:hi], own[lo:hi])
    return [r for part in parts for r in part]


@dataclass
class _Hashed:
    """Texts one behind the other, where they begin, and the sums that give the hash of any stretch."""

    text: np.ndarray
    bounds: np.ndarray
    sums: tuple[np.ndarray, np.ndarray]


def _portions(own: np.ndarray, times: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of hits that make about MOST_PAIRS pairs, none of which cuts a text; a text that makes more stands alone."""
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    sums = np.add.reduceat(times, begin)
    ends = np.append(begin[1:], len(own))
    out, at, size = [], 0, 0
    for k, n in enumerate(sums.tolist()):
        if size and size + n > MOST_PAIRS:
            out.append((int(begin[at]), int(begin[k])))
            at, size = k, 0
        size += n
    return [*out, (int(begin[at]), int(ends[-1]))]


def _by_stretches(index: Index, texts: _Hashed, hit: np.ndarray, at: np.ndarray, own: np.ndarray) -> list[list[tuple]]:
    """One text whose grams stand at many places of items: its diagonals go stretch by stretch, so pairs need bounded
    memory. Stretches of equal letters are searched once; STRETCH has every number of diagonals of a band as a
    divisor, and so the lengths that ruled lines and stuttering texts repeat at."""
    wide = 2 * (int(index.allowed.max()) + 1)
    reach = index.longest + wide + 2 * WINDOW
    text, base = texts.text, int(texts.bounds[own[0]])
    first = base - (index.longest // STRETCH + 1) * STRETCH
    known: dict[bytes, list[tuple]] = {}
    out = []
    for lo in range(first, int(hit[-1]) + 1, STRETCH):
        use = slice(*np.searchsorted(hit, [lo, lo + STRETCH + wide + index.longest]))
        if use.stop <= use.start:
            continue
        inside = lo - 2 * wide >= base and lo + STRETCH + reach <= len(text)
        letters = text[lo - 2 * wide : lo + STRETCH + reach].tobytes() if inside else None
        if letters is not None and letters in known:
            found = known[letters]
        else:
            found = [(o, i, w, e, s - lo, t - lo) for o, i, w, e, s, t in _placed(index, texts, hit[use], at[use], own[use], (lo, lo + STRETCH + wide))]
            if letters is not None:
                known = {letters: found} if len(known) > 8 else {**known, letters: found}
        out.append([(o, i, w, e, s + lo, t + lo) for o, i, w, e, s, t in found])
    return out


def _prefix_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of letters times powers of an odd number, and its inverse powers: hashes of any stretch modulo 2^64."""
    step = np.full(len(codes) + 1, MIX[0], np.uint64)
    back = np.full(len(codes) + 1, np.uint64(pow(int(MIX[0]), -1, 1 << 64)), np.uint64)
    step[0] = back[0] = 1
    values = (codes.astype(np.uint64) + np.uint64(1)) * MIX[1]
    values = (values ^ (values >> np.uint64(31))) * MIX[2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(step, dtype=np.uint64)[:-1], dtype=np.uint64)])
    return sums, np.cumprod(back, dtype=np.uint64)


def _stretch_hash(hashed: tuple[np.ndarray, np.ndarray], begin: np.ndarray, size: int) -> np.ndarray:
    sums, back = hashed
    return (sums[begin + size] - sums[begin]) * back[begin]


def _placed(index: Index, texts: _Hashed, hit: np.ndarray, at: np.ndarray, own: np.ndarray, diagonals: tuple[int, int] | None = None) -> list[tuple]:
    """What the hits of `search` lead to: a row per text, item and window, with its fewest edits and the outermost of its places."""
    text, bounds = texts.text, texts.bounds
    times = index.first[at + 1] - index.first[at]
    entry = np.repeat(index.first[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    item, place = index.item_of[entry].astype(np.int64), index.place_of[entry]
    hit, own = np.repeat(hit, times), np.repeat(own, times)
    if diagonals:
        use = (hit - place >= diagonals[0]) & (hit - place < diagonals[1])
        item, place, hit, own = item[use], place[use], hit[use], own[use]
    if not len(hit):
        return []
    shift = index.longest + WINDOW
    # Bands overlap by half: the diagonals of a placement with k edits span k at most.
    band = (hit - bounds[own] - place + shift) // (index.allowed[item] + 1)
    own, item, place, band = np.tile(own, 2), np.tile(item, 2), np.tile(place, 2), np.concatenate([band, band - 1])
    order = np.lexsort((place, band, item, own))
    own, item, place, band = own[order], item[order], place[order], band[order]
    # A window holds enough q-grams of a band where it holds some run of `need` consecutive ones. The
    # windows that hold a run are an interval, and both its ends grow along a band: each window is taken once.
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
    group = np.cumsum(fresh)
    run = np.arange(len(group))
    to = run + index.need[item] - 1
    run = run[to < len(group)]
    to = to[run]
    same = group[run] == group[to]
    run, to = run[same], to[same]
    first = np.maximum(place[to] - (index.size[item[run]] - Q), 0)
    last = np.minimum(place[run], index.n_windows[item[run]] - 1)
    some = first <= last
    run, first, last = run[some], first[some], last[some]
    if not len(run):
        return []
    again = np.concatenate([[False], group[run[1:]] == group[run[:-1]]])
    first = np.where(again, np.maximum(first, np.concatenate([[0], last[:-1] + 1])), first)
    times = np.maximum(last - first + 1, 0)
    found = []
    size, budget = index.size[item[run]], index.allowed[item[run]]
    for n, k in sorted(set(zip(size.tolist(), budget.tolist()))):
        these = np.flatnonzero((size == n) & (budget == k))
        ends = np.cumsum(times[these])
        for s in range(0, int(ends[-1]), ALIGNED):
            nth = np.arange(s, min(s + ALIGNED, int(ends[-1])))
            pick = np.searchsorted(ends, nth, side="right")
            of = these[pick]
            window = first[of] + nth - (ends[pick] - times[of])
            x = run[of]
            low = bounds[own[x]] + band[x] * (k + 1) - shift - k + window
            pattern = index.letters[(index.begin[item[x]] + window)[:, None] + np.arange(n)]
            # Equal stretches of text meet equal windows in a repetitive text: each such pair is aligned once.
            width = 2 * (k + 1) + 2 * k
            inner = (low >= 0) & (low + n + width <= len(text))
            codes = np.stack([_stretch_hash(texts.sums, np.where(inner, low, 0), n + width), _stretch_hash(index.sums, index.begin[item[x]] + window, n)])
            mixed = codes[0] * MIX[1] ^ (codes[1] * MIX[2] >> np.uint64(7)) ^ codes[1]
            mixed[~inner] = np.arange((~inner).sum(), dtype=np.uint64)
            _, one, back = np.unique(mixed, return_index=True, return_inverse=True)
            edits, start, end = (v[back] for v in _align(pattern[one], text, low[one], width))
            start, end = start - low[one][back] + low, end - low[one][back] + low
            good = edits <= k
            x = x[good]
            number = index.first_window[item[x]] + window[good]
            found.append(np.stack([own[x], item[x], number, edits[good], np.maximum(start[good], 0), np.minimum(end[good], len(text))]))
    rows = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
    if not rows.shape[1]:
        return []
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    begin = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]))
    return list(zip(*(v.tolist() for v in (*rows[:4, begin], np.minimum.reduceat(rows[4], begin), np.maximum.reduceat(rows[5], begin)))))


def _leaks(index: Index, texts: list[str | None]) -> list[tuple]:
    """(row, item, windows found, windows of the item, edits, start, end): a row per text and item."""
    out: dict[tuple, list] = {}
    at = 0
    while at < len(texts):
        codes, places, owner, size = [np.zeros(WINDOW, np.uint16)], [], [], 0
        while at < len(texts) and (not owner or size + len(texts[at] or "") <= CHUNK_CHARS):
            c, p = folded(texts[at] or "")
            codes += [c, np.zeros(WINDOW, np.uint16)]  # no window fits across two texts
            places.append(p)
            owner.append(at)
            size += len(c) + WINDOW
            at += 1
        bounds = np.cumsum([len(c) for c in codes])[:-1:2]
        for k, item, window, edits, start, end in search(index, np.concatenate(codes), bounds):
            p = places[k]
            lo, hi = max(0, start - int(bounds[k])), min(len(p), end - int(bounds[k]))
            if hi <= lo:
                continue
            row = out.setdefault((owner[k], item), [{}, int(p[lo]), int(p[hi - 1]) + 1])
            row[0][window] = min(edits, row[0].get(window, edits))
            row[1], row[2] = min(row[1], int(p[lo])), max(row[2], int(p[hi - 1]) + 1)
    return [(r, index.names[i], len(v[0]), int(index.n_windows[i]), sum(v[0].values()), v[1], v[2]) for (r, i), v in sorted(out.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of benchmark blocks of about BLOCK_CHARS, built on the driver one after the other."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    n = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield build(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


SCHEMA = "doc_id long, item_id long, windows_found int, windows int, edits int, start long, end long"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """SCHEMA: a row per document row and benchmark item of which it holds a window or more.

    Every WINDOW consecutive letters and digits of an item are a window, and a shorter item is one, so
    a quote of WINDOW letters is found wherever in the item it begins. A text region that lies
    within k edits of a window shares all but k * Q of its q-grams, on diagonals that span k at most;
    regions that do are aligned, and reported if they need EDIT_RATE edits per letter at most. Case,
    punctuation and white space do not count. start and end are code points of the whole text.

    One scan of the documents without a shuffle per BLOCK_CHARS of benchmark, which is what is
    broadcast. Null texts hold nothing; repeated rows are reported each. An empty benchmark finds nothing.
    """
    spark, parts = docs.sparkSession, []
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for index in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            forget_encoders()
            local = Index(**shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[first + r], *rest) for first, texts in slices(batch.column(1), CHUNK_CHARS) for r, *rest in _leaks(local, texts.to_pylist())]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split(" ")[0] for x in SCHEMA.split(", ")])

        parts.append(two.mapInArrow(run, SCHEMA))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark window, unchanged, in one scan without a shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            forget_encoders()
            local = Index(**shared.value)
            for batch in batches:
                for first, texts in slices(batch.column(at), CHUNK_CHARS):
                    bad = {r[0] for r in _leaks(local, texts.to_pylist())}
                    keep = pa.array([k not in bad for k in range(len(texts))], pa.bool_())
                    yield batch.slice(first, len(texts)).filter(keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
