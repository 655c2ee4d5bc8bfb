"""Connected components on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) undirected edges -> (node, component), the smallest node reachable.

    Alternates two star steps until nothing changes: every node hooks its larger
    neighbours onto the smallest one it knows, then all its smaller ones. Minima are partial
    aggregates and joins are plain equi-joins, so a hub with any number of links is spread by
    Spark's own skew handling. The edge count never grows, and the rounds are logarithmic in
    the longest chain; running out of `max_rounds` raises.

    Nulls, self loops and repeated edges are ignored. An empty table gives an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    pairs = staged(pairs, "edges")
    before = _state(pairs)
    for _ in range(max_rounds):
        pairs = staged(_small_star(_large_star(pairs)), "edges")
        now = _state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """Count and order-free digest of the edge set: one row to the driver."""
    mixed = F.xxhash64("u", "v")
    row = pairs.agg(F.count(F.lit(1)), F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.bit_xor(mixed)).first()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # v's neighbours above it are its `u`; those below it only matter through their minimum.
    return pairs.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u")
    hooked = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.union(least.select("u", F.col("m").alias("v"))).distinct()
