"""Deterministic samples ordered by a hash of a seed and the row key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SALTS = 64


def draw(seed: int, key: list[str]) -> Column:
    """Random-looking but repeatable order of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def _smallest(df: DataFrame, group: list[str], order: str, n) -> DataFrame:
    """The n rows with the smallest order per group, in two rounds so no group meets in one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    local = Window.partitionBy(*group, "_salt").orderBy(order)
    some = salted.withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    final = Window.partitionBy(*group).orderBy(order)
    return some.withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= n)


def _least_draws(rows: DataFrame, stratum: str, sizes: DataFrame, wanted: int) -> DataFrame:
    """At least the `wanted` rows of each stratum with the smallest draws, all of a smaller one, and not many more.

    The draw is uniform, so a threshold for each stratum follows from its size; the rows below it are written and
    counted, and where a threshold was too low it is doubled. No row above the threshold is sorted or shuffled.
    """
    part = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    room = wanted + 6 * math.sqrt(wanted) + 16
    while True:
        cuts = sizes.select(F.col(stratum).alias("_s"), (F.lit(room) / F.col("_c")).alias("_cut"))
        below = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("_s"))).filter(part < F.col("_cut")).drop("_s", "_cut")
        below = cut_lineage(below)
        got = below.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_got"))
        short = sizes.join(got, F.col(stratum).eqNullSafe(F.col("_s")), "left").filter(F.coalesce("_got", F.lit(0)) < F.least("_c", F.lit(wanted)))
        if short.limit(1).count() == 0:
            return below
        room *= 2


def stratified(df: DataFrame, stratum: str, key: list[str], size: int, seed: int = 42) -> DataFrame:
    """`size` rows, split evenly over strata, topped up from the rest; everything if it is small.

    Rows rank by their draw inside the stratum. The quota takes ranks up to size // strata;
    what is missing is topped up in order of the draw from rows beyond the quota.
    """
    rows = df.withColumn("_draw", draw(seed, key))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    plan = sizes.agg(F.sum("_c").alias("all"), F.count(F.lit(1)).alias("k")).first()
    if not plan["all"] or plan["all"] <= size:
        return df
    quota = size // plan["k"]
    got = sizes.agg(F.sum(F.least("_c", F.lit(quota)))).first()[0]
    # Beyond the quota no more than `size` rows of a stratum can be wanted.
    wanted = quota + size - got
    ranked = _smallest(_least_draws(rows, stratum, sizes, wanted), [stratum], "_draw", wanted)
    chosen = ranked.filter(F.col("_rn") <= quota)
    if got < size:
        extra = ranked.filter(F.col("_rn") > quota).orderBy("_draw", *key).limit(size - got)
        chosen = chosen.unionByName(extra)
    return chosen.select(*df.columns)


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the smallest draws first."""
    return df.withColumn("_draw", draw(seed, key)).orderBy("_draw", *key).limit(n).drop("_draw")


def block_sample(df: DataFrame, key: list[str], n_per_block: int, seed: int = 42) -> DataFrame:
    """n rows from every input block (file and byte range), and the block they are from: its file's name and where it begins."""
    blocks = df.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"), F.col("_metadata.file_path").alias("_path"))
    return _smallest(blocks.withColumn("_draw", draw(seed, key)), ["_path", "block"], "_draw", n_per_block).select(*df.columns, "block")


def drawn_parts(spark: SparkSession, folder: str, n: int, seed: int = 42, whole_folders: bool = False) -> list[str]:
    """The `n` files below a folder, or folders of a partitioned table, whose names have the smallest draws. Files are listed, none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path")
    if whole_folders:
        files = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    name = F.substring_index("path", "/", -1)
    return [r["path"] for r in files.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), name)), "path").limit(n).collect()]


def part_sample(spark: SparkSession, folder: str, n: int, seed: int = 42, whole_folders: bool = False) -> DataFrame:
    """All rows of `n` files (or partitions) drawn by name, with the `file` they are from. The others are not read, so the
    bytes read fall with their share."""
    paths = drawn_parts(spark, folder, n, seed, whole_folders)
    rows = spark.read.option("basePath", folder).parquet(*paths)
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def split(df: DataFrame, key: list[str], test_percent: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test sets by hash bucket."""
    bucket = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("bigint") % 100
    return df.filter(bucket >= test_percent), df.filter(bucket < test_percent)
