"""Prefix trie of rebuilt conversations from composable fingerprints; no rebuilt text is made."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import with_ordered
from .stage import staged

#: A rebuilt conversation begins with fewer than HEADS turns of its base, the conversation that opens its hundred.
HEADS, HUNDRED = 6, 100
#: Turns that are multiplied in one go; longer conversations are products of such blocks.
BLOCK = 4_096
#: Bytes of decimal ids that are hashed at a time.
CHUNK = 1 << 20

P = (1 << 61) - 1
BASES = (0x1D8AF066F5C1A9B3 % P, 0x0E3779B97F4A7C15 % P)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 for numbers below it."""
    low, thirty = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = al * bh + ah * bl
    r = np.uint64(2) * ah * bh + (mid >> np.uint64(30)) + ((mid & thirty) << np.uint64(31)) + al * bl
    r = (r & np.uint64(P)) + (r >> np.uint64(61))
    return np.where(r >= P, r - np.uint64(P), r)


def _reduced(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) % np.uint64(P)


def _power(lane: int, n: np.ndarray) -> np.ndarray:
    """The lane's base to each of the powers n."""
    values, back = np.unique(n, return_inverse=True)
    return np.array([pow(BASES[lane], int(k), P) for k in values], np.uint64)[back]


def product(lane: int, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprint of one sequence followed by another of n turns.

    A sequence of n turns is the map x -> x * base^n + value; values of neighbouring sequences compose
    as these maps do, whatever the turns in them are.
    """
    r = mulmod(left, _power(lane, n)) + right
    return np.where(r >= P, r - np.uint64(P), r)


def before_last(lane: int, value: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Fingerprint of a sequence without its last turn."""
    return mulmod((value + np.uint64(P) - turn) % np.uint64(P), np.full(len(value), pow(BASES[lane], -1, P), np.uint64))


def running(lane: int, turn: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Product of each row's segment up to the row; `start` is where the row's segment begins. In log steps."""
    value, step, at = turn.copy(), 1, np.arange(len(turn))
    while True:
        rows = np.flatnonzero(at - step >= start)
        if not len(rows):
            return value
        value[rows] = product(lane, value[rows - step], value[rows], np.full(len(rows), step))
        step *= 2


def _arrow(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if isinstance(a, np.ndarray) and a.dtype == np.uint64 else a, pa.int64()) for a in arrays], names)


def _longs(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns]


def _scanned(rows: DataFrame) -> DataFrame:
    """(conv, nth, t1, t2) -> with block, in_block, v1, v2: the product of the block's turns up to this one. Blocks are dealt out, not conversations."""
    cut = rows.select("conv", F.col("nth").cast("long").alias("nth"), F.floor(F.col("nth") / BLOCK).cast("long").alias("block"), "t1", "t2")
    dealt = cut.repartition(F.col("conv"), F.col("block")).sortWithinPartitions("conv", "block", "nth")

    def run(batches: Iterator[pa.RecordBatch]):
        last, values, held = None, [0, 0], 0
        for batch in batches:
            conv, nth, block, *turns = _longs(batch)
            if not len(conv):
                continue
            fresh = np.concatenate([[True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
            on = int(np.argmax(fresh[1:])) + 1 if fresh[1:].any() else len(conv)
            goes_on = last == (conv[0], block[0])
            turns, out = [_reduced(t) for t in turns], []
            for lane, t in enumerate(turns):
                v = running(lane, t, start)
                if goes_on:
                    v[:on] = product(lane, np.full(on, values[lane], np.uint64), v[:on], np.arange(1, on + 1))
                out.append(v)
            last, values = (conv[-1], block[-1]), [int(v[-1]) for v in out]
            yield _arrow(["conv", "nth", "block", "t1", "t2", "v1", "v2"], [conv, nth, block, *turns, *out])

    return dealt.mapInArrow(run, "conv long, nth long, block long, t1 long, t2 long, v1 long, v2 long")


def _before_blocks(blocks: DataFrame) -> DataFrame:
    """(conv, block, n, v1, v2, l1, l2) -> (conv, block, l1, l2): the head's product and those of all blocks before."""
    dealt = blocks.repartition(F.col("conv")).sortWithinPartitions("conv", "block")

    def run(batches: Iterator[pa.RecordBatch]):
        last, left = None, [0, 0]
        for batch in batches:
            rows = list(zip(*(c.tolist() for c in _longs(batch))))
            out = []
            for conv, block, n, v1, v2, l1, l2 in rows:
                if conv != last:
                    last, left = conv, [l1, l2]
                out.append((conv, block, *left))
                left = [(x * pow(b, n, P) + v) % P for x, b, v in zip(left, BASES, (v1, v2))]
            yield _arrow(["conv", "block", "l1", "l2"], [[r[i] for r in out] for i in range(4)])

    return dealt.select("conv", "block", "n", "v1", "v2", "l1", "l2").mapInArrow(run, "conv long, block long, l1 long, l2 long")


_MEMBER = ["conv", "depth", "f1", "f2", "g1", "g2", "ref_conv", "ref_pos"]


def _composed(rows: DataFrame) -> DataFrame:
    """(conv, depth, l1, l2, v1, v2, n, t1, t2, ref_conv, ref_pos) -> _MEMBER: left times value, and the same without the last turn."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            conv, depth, l1, l2, v1, v2, n, t1, t2, ref_conv, ref_pos = _longs(batch)
            f = [product(k, a.view(np.uint64), v.view(np.uint64), n) for k, (a, v) in enumerate(((l1, v1), (l2, v2)))]
            g = [before_last(k, x, t.view(np.uint64)) for k, (x, t) in enumerate(zip(f, (t1, t2)))]
            yield _arrow(_MEMBER, [conv, depth, *f, *g, ref_conv, ref_pos])

    order = ["conv", "depth", "l1", "l2", "v1", "v2", "n", "t1", "t2", "ref_conv", "ref_pos"]
    return rows.select(*(F.col(c).cast("long").alias(c) for c in order)).mapInArrow(run, ", ".join(f"{c} long" for c in _MEMBER))


def _head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS))


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, role, text, chars, t1, t2): turns numbered from 0 by turn (null first), role and text.

    Numbers are given in blocks of the turn column, so a conversation of any length is spread.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "text")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    done = with_ordered(rows.withColumn("place", place), ["conv"], "place", block=block, number="nth")
    return done.select(
        "conv", (F.col("nth") - 1).alias("pos"), "role", "text", F.length("text").cast("long").alias("chars"),
        F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("2"), "text", F.lit("1"), "role").alias("t2"))


def _members(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_MEMBER for every conversation and depth from 1 on, and (conv, depth) of every rebuilt conversation's end."""
    base = F.col("conv") - F.col("conv") % HUNDRED
    opening = turns.filter((F.col("conv") % HUNDRED == 0) & (F.col("pos") < HEADS - 1))
    heads = staged(_scanned(opening.withColumn("nth", F.col("pos"))).select(F.col("conv").alias("base"), (F.col("nth") + 1).alias("d"), "t1", "t2", F.col("v1").alias("h1"), F.col("v2").alias("h2")), "heads")
    convs = turns.groupBy("conv").agg(F.max("pos").alias("top")).withColumn("base", base).withColumn("h", _head_length(F.col("conv")))
    sizes = heads.groupBy("base").agg(F.max("d").alias("there"))
    convs = convs.join(sizes, "base", "left").withColumn("hh", F.least("h", F.coalesce("there", F.lit(0))))
    convs = staged(convs.select("conv", "base", "h", "hh", (F.col("hh") + F.greatest(F.col("top") + 1 - F.col("h"), F.lit(0))).alias("end")), "convs")
    own = turns.select("conv", "pos", "t1", "t2").withColumn("h", _head_length(F.col("conv"))).filter("pos >= h")
    suffix = staged(_scanned(own.withColumn("nth", F.col("pos") - F.col("h"))), "suffixes")
    last = F.max(F.struct("nth", "v1", "v2")).alias("m")
    blocks = suffix.groupBy("conv", "block").agg(last).select("conv", "block", (F.col("m.nth") % BLOCK + 1).alias("n"), "m.v1", "m.v2")
    head = heads.select("base", F.col("d").alias("hh"), "h1", "h2")
    blocks = blocks.join(convs, "conv").join(head, ["base", "hh"], "left").withColumn("l1", F.coalesce("h1", F.lit(0))).withColumn("l2", F.coalesce("h2", F.lit(0)))
    before = _before_blocks(blocks)
    later = suffix.join(before, ["conv", "block"]).join(convs, "conv").select(
        "conv", (F.col("hh") + F.col("nth") + 1).alias("depth"), "l1", "l2", "v1", "v2", (F.col("nth") % BLOCK + 1).alias("n"), "t1", "t2",
        F.col("conv").alias("ref_conv"), (F.col("nth") + F.col("h")).alias("ref_pos"))
    zero = F.lit(0)
    early = convs.join(heads, "base").filter("d <= hh").select(
        "conv", F.col("d").alias("depth"), zero.alias("l1"), zero.alias("l2"), F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.col("d").alias("n"), "t1", "t2",
        F.col("base").alias("ref_conv"), (F.col("d") - 1).alias("ref_pos"))
    return staged(_composed(early.unionByName(later)), "members"), convs.select("conv", F.col("end").alias("depth"))


def _verified(members: DataFrame, nodes: DataFrame, turns: DataFrame) -> None:
    """Raise unless, in every node, the turns its members refer to say the same as the turn of its smallest one.

    Parents are nodes too, so by induction whole sequences are equal. Only different references are compared.
    """
    key = ["depth", "f1", "f2"]
    several = nodes.filter("low <> high").select(*key, F.col("low").alias("first"), "g1", "g2")
    parted = nodes.filter("not same_parent").limit(1).count()
    ref = F.struct(F.col("ref_conv").alias("c"), F.col("ref_pos").alias("p"))
    pairs = members.withColumn("ref", ref).join(several.select(*key, "first"), key).filter("ref <> first").select("ref", "first").distinct()
    said = turns.select(F.struct(F.col("conv").alias("c"), F.col("pos").alias("p")).alias("ref"), F.struct("role", "text").alias("said"))
    both = pairs.join(said, "ref").join(said.select(F.col("ref").alias("first"), F.col("said").alias("first_said")), "first")
    if parted or both.filter("said <> first_said").limit(1).count():
        raise RuntimeError("two different prefixes share a fingerprint")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(top, depth, conv) -> (top, depth, ends_sha256). Ids are sorted and joined in parts over all tasks; only the hash goes through them in order."""
    dealt = ends.repartitionByRange("top", "depth", "conv").sortWithinPartitions("top", "depth", "conv")

    def joined(batches: Iterator[pa.RecordBatch]):
        key, ids, size = None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for top, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != (top, depth) or size >= CHUNK):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                key = (top, depth)
                ids.append(conv)
                size += len(str(conv)) + 1
            yield _parts(out)
            out = []
        if ids:
            yield _parts([(*key, ids[0], ",".join(map(str, ids)))])

    def _parts(rows):
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.large_string())], ["top", "depth", "first", "part"])

    parts = dealt.mapInArrow(joined, "top long, depth long, first long, part string")
    ordered = parts.repartition(F.col("top"), F.col("depth")).sortWithinPartitions("top", "depth", "first")

    def digest(batches: Iterator[pa.RecordBatch]):
        key, sha = None, None
        for batch in batches:
            out = []
            for top, depth, part in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if key != (top, depth):
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (top, depth), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(part.encode())
            yield _rows(out)
        if key:
            yield _rows([(*key, sha.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["top", "depth", "ends_sha256"])

    return ordered.mapInArrow(digest, "top long, depth long, ends_sha256 string")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """(top, up, leaves, saved) -> the sums over all chains below and including each, by doubling the reach.

    Chain `top` hangs on chain `up`. Each round adds the sums of the chains whose ancestor at the reached
    distance it is, so the rounds are logarithmic in the height of the tree of chains.
    """
    now = chains
    while now.filter("up is not null").limit(1).count():
        add = now.filter("up is not null").groupBy(F.col("up").alias("top")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        over = now.select(F.col("top").alias("up"), F.col("up").alias("next"))
        grown = now.join(add, "top", "left").join(over, "up", "left")
        zero = F.lit(0)
        now = staged(grown.select("top", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved")), "chains")
    return now


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256), all long but the last.

    Conversation c is rebuilt as the first h turns of conversation c - c % 100, then its own after its first h;
    h is crc32 of its decimal number modulo 6. The fingerprint of a prefix is the product of the base's head and
    of a stretch of own turns, computed once each; equal fingerprints are one node, whose members' last turns
    are then compared by reference. A node is named by its smallest member, so the nodes of one name are a chain,
    and sums over subtrees go along chains and over the tree of chains.

    Null roles and texts are empty; turns go by turn (null first), role and text, and repeated rows stay. Rows without a
    conv_id are left out. % keeps the sign, so -5 belongs to 0. Other columns are not read. An empty table has no node.
    """
    turns = staged(stored_turns(conversations), "turns")
    members, ends = _members(turns)
    ends = staged(ends, "ends")
    key = ["depth", "f1", "f2"]
    ref = F.struct(F.col("ref_conv").alias("c"), F.col("ref_pos").alias("p"))
    grouped = members.withColumn("ref", ref).groupBy(*key).agg(
        F.min("conv").alias("top"), F.count(F.lit(1)).alias("n_convs"), F.min("ref").alias("low"), F.max("ref").alias("high"), F.min("g1").alias("g1"), F.min("g2").alias("g2"),
        ((F.min("g1") == F.max("g1")) & (F.min("g2") == F.max("g2"))).alias("same_parent"))
    nodes = staged(grouped, "nodes")
    _verified(members, nodes, turns)
    chars = turns.select(F.struct(F.col("conv").alias("c"), F.col("pos").alias("p")).alias("low"), "chars")
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv").alias("top"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "top", "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("g1"), F.lit(None).cast("long").alias("g2"))
    known = staged(nodes.join(chars, "low").select("depth", "f1", "f2", "top", "n_convs", "chars", "g1", "g2").union(root), "known")
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("top").alias("parent"))
    children = known.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = known.join(parents, ["depth", "g1", "g2"], "left").join(children, key, "left")
    value = full.select(
        "top", "depth", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("save"))
    value = staged(value, "values")
    chains = value.groupBy("top").agg(F.min("depth").alias("begin"), F.min_by("parent", "depth").alias("up"), F.sum("leaf").alias("leaves"), F.sum("save").alias("saved"))
    chains = staged(chains, "chains")
    totals = _chain_totals(chains.select("top", "up", "leaves", "saved")).drop("up")
    hung = totals.join(chains.select("top", "begin", "up"), "top").filter("up is not null").groupBy(F.col("up").alias("top"), (F.col("begin") - 1).alias("depth")).agg(
        F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    lined = value.join(hung, ["top", "depth"], "left").withColumn("leaf", F.col("leaf") + F.coalesce("hung_leaves", zero)).withColumn("save", F.col("save") + F.coalesce("hung_saved", zero))
    summed = with_ordered(lined, ["top"], "depth", span=BLOCK, running={"leaves_to": "leaf", "saved_to": "save"})
    digests = _ends_digests(_named_ends(ends, members, known))
    out = summed.join(totals, "top").join(digests, ["top", "depth"], "left")
    return out.select(
        F.col("top").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved") - F.col("saved_to") + F.col("save")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def _named_ends(ends: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """(top, depth, conv): the node at which each rebuilt conversation ends."""
    names = known.select("depth", "f1", "f2", "top")
    at = ends.join(members.select("conv", "depth", "f1", "f2"), ["conv", "depth"]).select("conv", "depth", "f1", "f2")
    zero = F.lit(0).cast("long")
    empty = ends.filter("depth = 0").select("conv", "depth", zero.alias("f1"), zero.alias("f2"))
    return at.union(empty).join(names, ["depth", "f1", "f2"]).select("top", "depth", "conv")
