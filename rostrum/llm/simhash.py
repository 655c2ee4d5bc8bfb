"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import perhaps_listed
from .graph import components
from .stage import forget_encoders, staged

SEED = 42
BLOCK_BYTES = 1 << 20
#: Fingerprints in a tile that travels, and in the tiles compared at a time inside it.
TILE = 16_384
INNER = 1_024
GOLDEN = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """A further 64 bits from each hash; word 0 is the hash itself."""
    if word == 0:
        return h
    z = h + np.uint64((GOLDEN * word) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _bit_counts(h: np.ndarray, words: int) -> np.ndarray:
    """How many hashes set each of the 64 * words bits, highest bit first."""
    total = np.zeros(64 * words, dtype=np.int64)
    for start in range(0, len(h), 255):  # sums of 255 bits fit in a byte
        part = h[start : start + 255]
        wide = np.stack([_mixed(part, k) for k in range(words)], axis=1).astype(">u8")
        total += np.add.reduce(np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1), axis=0, dtype=np.uint8)
    return total


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of `data`, a megabyte of text at a time, never cutting a word."""
    start = 0
    while start < len(data):
        end = min(len(data), start + BLOCK_BYTES)
        if end < len(data):
            cut = max(data.rfind(s, start, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= start:  # one word longer than a block
                cut = min((p for p in (data.find(s, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0), default=len(data))
            end = cut
        yield data[start:end].split()
        start = end


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> tuple[bytes, int]:
    """SimHash of the whole text in 64 * words bits, and its number of shingles.

    A-Z are lower-cased; words are runs without ASCII white space (which is how `bytes.split`
    cuts). Shorter texts have their whole word sequence as the one shingle; none or null: zeros.
    """
    total, n, kept = np.zeros(64 * words, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in _word_blocks(text.encode("utf-8", "surrogatepass").lower() if text else b""):
        kept += block
        if len(kept) >= shingle:
            grams = map(b" ".join, zip(*(kept[i:] for i in range(shingle))))
            h = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=len(kept) - shingle + 1)
            total += _bit_counts(h, words)
            n += len(h)
            kept = kept[len(kept) - shingle + 1 :]
    if not n and kept:
        total, n = _bit_counts(np.array([digest(b" ".join(kept), SEED)], dtype=np.uint64), words), 1
    return np.packbits(2 * total > n).tobytes(), n


#: Base of the packed population counts; a quarter of a fingerprint has fewer bits.
SIDE = 4_096


def _quarters(fps: list[bytes]) -> np.ndarray:
    """The population counts of the four quarters of each fingerprint, packed into one integer."""
    if not fps:
        return np.zeros(0, dtype=np.int64)
    ones = np.bitwise_count(np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(len(fps), 4, -1)).sum(axis=2, dtype=np.int64)
    return ((ones[:, 0] * SIDE + ones[:, 1]) * SIDE + ones[:, 2]) * SIDE + ones[:, 3]


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary, n_shingles, quarters, k): one row per input row, in one scan without a shuffle.

    k stands for the text beside its id: a hash, the largest number of all for a null.
    """

    def run(batches):
        forget_encoders()
        for b in batches:
            done = [fingerprint(t.as_py(), shingle, words) for t in b.column(1)]
            fps = [x[0] for x in done]
            cols = [b.column(0), pa.array(fps, pa.binary()), pa.array([x[1] for x in done], pa.int64()), pa.array(_quarters(fps)), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "fp", "n_shingles", "quarters", "k"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _text_key(F.col(text_col)).alias("k"))
    return rows.mapInArrow(run, "id long, fp binary, n_shingles long, quarters long, k long")


def _text_key(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text.cast("string"))).otherwise(F.lit((1 << 63) - 1))


def _cells(fps: DataFrame, radius: int, least_ratio: float | None) -> tuple[DataFrame, list[int]]:
    """A tile cell for each fingerprint, and the steps from a cell to those that can hold its links.

    Without `least_ratio` a cell is the four population counts of the fingerprint's quarters:
    a link of `radius` bits moves them by `radius` in sum at most, so all other tile pairs are
    skipped unread. With it, linked texts may differ in their number of shingles by that ratio
    at most, and a cell is a band of that number.
    """
    if least_ratio:
        width = float(-np.log(least_ratio))
        return fps.withColumn("cell", F.floor(F.log(F.greatest("n_shingles", F.lit(1)).cast("double")) / width).cast("long")), [0, 1]
    reach = range(-radius, radius + 1)
    near = [(a, b, c, d) for a in reach for b in reach for c in reach for d in reach if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    steps = [((a * SIDE + b) * SIDE + c) * SIDE + d for a, b, c, d in near]
    return fps.withColumn("cell", F.col("quarters")), sorted(s for s in steps if s >= 0)


def _tiles(fps: DataFrame) -> DataFrame:
    """(cell, sub, fps, nodes): cells cut by hash into tiles of about TILE fingerprints."""
    cuts = fps.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("cuts"))
    placed = fps.join(cuts, "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("cuts")))
    # A key of its own: rows dealt out by cell for the join must be dealt anew, or a large cell stays in one task.
    tile = F.concat_ws(":", "cell", "sub").alias("tile")
    rows = placed.groupBy(tile).agg(F.min("cell").alias("cell"), F.min("sub").alias("sub"), F.collect_list(F.struct("fp", "node")).alias("rows"))
    return rows.select("cell", "sub", "rows.fp", "rows.node")


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of i and j, in place; labels stay the smallest index of their group."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _close(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at `radius` or fewer differing bits. Exact: a pair is given up once part of it differs more."""
    head = min(x.shape[1], 3)
    apart = np.bitwise_count(x[:, 0][:, None] ^ y[:, 0][None, :])
    if head > 1:
        apart = apart.astype(np.uint16)
        for k in range(1, head):
            apart += np.bitwise_count(x[:, k][:, None] ^ y[:, k][None, :])
    i, j = np.nonzero(apart <= radius)
    if head < x.shape[1]:
        whole = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64) <= radius
        i, j = i[whole], j[whole]
    return i, j


def tile_links(fa: list[bytes], na: np.ndarray, fb: list[bytes] | None, nb: np.ndarray | None, radius: int):
    """A spanning forest of the links between two tiles (or within one): pairs of nodes.

    Inner tiles are sorted by population count and skipped when the counts of a pair differ
    by more than `radius` throughout.
    """
    a = np.frombuffer(b"".join(fa), dtype=np.uint64).reshape(len(fa), -1)
    b = a if fb is None else np.frombuffer(b"".join(fb), dtype=np.uint64).reshape(len(fb), -1)
    pa_, pb_ = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (a, b))
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb_, kind="stable")
    a, pa_, b, pb_ = a[oa], pa_[oa], b[ob], pb_[ob]
    nodes = na[oa] if fb is None else np.concatenate([na[oa], nb[ob]])
    shift = 0 if fb is None else len(a)
    label = np.arange(len(nodes))
    for s in range(0, len(a), INNER):
        for t in range(s if fb is None else 0, len(b), INNER):
            if pb_[t] - pa_[min(s + INNER, len(a)) - 1] > radius or pa_[s] - pb_[min(t + INNER, len(b)) - 1] > radius:
                continue
            i, j = _close(a[s : s + INNER], b[t : t + INNER], radius)
            _unite(label, i + s, j + t + shift)
    hooked = np.nonzero(label != np.arange(len(label)))[0]
    return nodes[hooked], nodes[label[hooked]]


def links(distinct: DataFrame, radius: int, least_ratio: float | None = None) -> DataFrame:
    """(a, b) node pairs that connect whatever fingerprints lie within `radius` bits of each other.

    `distinct`: (fp, node, n_shingles, quarters), a row per different fingerprint. Each tile meets
    each tile of its own and the neighbouring cells once; of the links that a tile pair holds, as
    many as connect the same fingerprints come out, so dense groups give no more rows than members.
    """
    celled, steps = _cells(distinct, radius, least_ratio)
    tiles = staged(_tiles(celled), "tiles")
    right = tiles.select(F.col("cell").alias("to"), F.col("sub").alias("to_sub"), F.col("fp").alias("to_fp"), F.col("node").alias("to_node"))
    left = tiles.withColumn("to", F.explode(F.array(*[(F.col("cell") + F.lit(s)).cast("long") for s in steps])))
    met = left.join(right, "to").filter("to > cell or to_sub >= sub")
    one = (F.col("to") == F.col("cell")) & (F.col("to_sub") == F.col("sub"))
    pairs = met.select("fp", "node", "to_fp", "to_node", one.alias("one"))

    def run(batches):
        for batch in batches:
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for k in range(batch.num_rows):
                fa, na, fb, nb = (batch.column(c)[k].values for c in range(4))
                own = batch.column(4)[k].as_py()
                u, v = tile_links(fa.to_pylist(), na.to_numpy(), None if own else fb.to_pylist(), None if own else nb.to_numpy(), radius)
                out[0].append(u)
                out[1].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _families(fps: DataFrame, radius: int, least_ratio: float | None) -> DataFrame:
    """(fp, top): every different fingerprint with the first of its component, (least id, fp).

    Fingerprints have numbers of their own, so rows that share an id do not hang together through it.
    """
    grouped = fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("least"), F.min("n_shingles").alias("n_shingles"), F.min("quarters").alias("quarters"))
    distinct = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "distinct")
    linked = components(links(distinct, radius, least_ratio)).join(distinct.select("node", "least", "fp"), "node")
    first = linked.groupBy("component").agg(F.min(F.struct("least", "fp")).alias("top"))
    of_linked = linked.select("node", "component").join(first, "component").select("node", "top")
    return distinct.join(of_linked, "node", "left").select("fp", F.coalesce("top", F.struct("least", "fp")).alias("top"))


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 2, least_ratio: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Documents whose fingerprints differ in `radius` bits or fewer are linked; component_id is the
    smallest id reachable over links. Equal fingerprints are compared once, so copies cost
    nothing. Null and wordless texts share the zero fingerprint and are linked like any other.
    A row without an id links nothing: it gets its fingerprint and a null component. Rows that
    repeat an id are documents of their own: each goes by its fingerprint, and nothing is linked through
    the id. Other columns are not read.
    """
    fps = staged(fingerprints(docs, shingle, words, id_col, text_col), "fingerprints")
    out = fps.join(_families(fps, radius, least_ratio), "fp", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("top.least")).alias("component_id"),
    )


#: Bits and shingle of the corpus de-duplication; the radius stands for a Jaccard similarity of 0.8.
STAGE_WORDS, STAGE_SHINGLE, STAGE_SIMILARITY = 8, 5, 0.8


def similarity_radius(similarity: float, words: int) -> int:
    """Differing bits that shingle multisets of a Jaccard similarity are expected to have.

    Of a bit, the chance to differ is the angle over pi; the cosine of texts of about one length
    is 2 s / (1 + s).
    """
    return int(round(64 * words * np.arccos(2 * similarity / (1 + similarity)) / np.pi))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each near-duplicate group: the smallest doc_id's.

    Five-word shingles, 512 bits, and the radius of a Jaccard similarity of 0.8. Rows without
    a doc_id stay. Rows that share a doc_id but not a group are kept or dropped each for itself. Within a group the
    smallest doc_id's row stays, once if it is repeated; of its texts with one fingerprint, one, rather not a null.

    What is dropped is named by id and a hash of the text. Texts that cannot be on that list, by a bitmap of it, do not move.
    """
    words, shingle = STAGE_WORDS, STAGE_SHINGLE
    fps = staged(fingerprints(docs, shingle, words), "fingerprints").filter("id is not null")
    rows = fps.groupBy("id", "fp", "k").agg(F.count(F.lit(1)).alias("n"))
    rows = staged(rows.join(_families(fps, similarity_radius(STAGE_SIMILARITY, words), STAGE_SIMILARITY), "fp"), "families")
    first = F.min(F.struct("k", "n")).alias("m")
    kept = rows.filter("id = top.least and fp = top.fp").groupBy("id", "fp").agg(first).select("id", "m.k", "m.n")
    kept = staged(kept, "kept")
    dropped = rows.select("id", "k").join(kept, ["id", "k"], "left_anti")
    again = kept.filter("n > 1").select("id", "k")  # rows that are repeated are reduced to one
    listed = dropped.withColumn("_once", F.lit(False)).union(again.withColumn("_once", F.lit(True)))
    listed = staged(listed.select(F.col("id").alias("_id"), F.col("k").alias("_k"), "_once"), "listed")
    n, n_again = listed.agg(F.count(F.lit(1)), F.count_if("_once")).first()
    named = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), _text_key(F.col("text")).alias("_k"))
    marked, perhaps = perhaps_listed(named, listed, ["_id", "_k"], n)
    stay = marked.filter(~perhaps).select("_doc.*")
    found = marked.filter(perhaps).join(listed, ["_id", "_k"], "left")
    left = stay.union(found.filter("_once is null").select("_doc.*"))
    if n_again:
        one = found.filter("_once").groupBy("_id", "_k").agg(F.any_value("_doc").alias("_doc"))
        left = left.union(one.select("_doc.*"))
    return left
