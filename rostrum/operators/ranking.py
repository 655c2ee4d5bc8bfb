"""Ranks, quantiles and ROC from counts per distinct value, without sorting a group in one task.

Rows are first reduced to one row per (group, value). Every group is then cut into value blocks; cumulative counts run inside blocks and over
the block totals. The cut points come from values picked by their hash, so a task
that is run again finds the same cut points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 16_384
BLOCKS = 256
_ALL = "_all"


def cumulative(
    df: DataFrame, keys: list[str], value: str, weights: dict[str, Column] | None = None, *, sample: int = SAMPLE
) -> DataFrame:
    """One row per (keys, value) with, for every weight w: w, w_before and w_total.

    w_before sums the rows of the group with a smaller value. Null values are left out.
    """
    weights = weights or {"n": F.lit(1)}
    ks = keys or [_ALL]
    base = df if keys else df.withColumn(_ALL, F.lit(1))
    counts = (
        base.filter(F.col(value).isNotNull())
        .groupBy(*ks, value)
        .agg(*[F.sum(w).alias(name) for name, w in weights.items()])
    )
    sizes = counts.groupBy(*ks).agg(F.count(F.lit(1)).alias("_d"))
    every = F.greatest(F.lit(1), F.floor(F.col("_d") / F.lit(sample))).cast("bigint")
    picked = counts.join(sizes, ks).filter(F.pmod(F.xxhash64(*ks, value), every) == 0)
    at = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    cuts = picked.groupBy(*ks).agg(F.percentile(F.col(value).cast("double"), at).alias("_cuts"))
    # Number of cut points below the value, by halving steps.
    steps = F.array(*[F.lit(BLOCKS >> i) for i in range(1, BLOCKS.bit_length())])
    block = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(value), at + step).otherwise(at)
    )
    blocked = counts.join(cuts, ks, "left").withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(block)).drop("_cuts")
    totals = blocked.groupBy(*ks, "_b").agg(*[F.sum(w).alias(w) for w in weights])
    prior = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*ks)
    offsets = totals.select(
        *ks,
        "_b",
        *[F.coalesce(F.sum(w).over(prior), F.lit(0)).alias(f"_{w}_off") for w in weights],
        *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
    )
    inner = Window.partitionBy(*ks, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.join(offsets, [*ks, "_b"])
    return out.select(
        *keys,
        value,
        *weights,
        *[(F.coalesce(F.sum(w).over(inner), F.lit(0)) + F.col(f"_{w}_off")).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights],
    )


def percent_rank_avg(df: DataFrame, keys: list[str], value: str, out: str, **kw) -> DataFrame:
    """Rank with averaged ties divided by the number of non-null values; null stays null."""
    ranks = cumulative(df, keys, value, **kw).select(
        *keys, value, ((F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)) / F.col("n_total")).alias(out)
    )
    return df.join(ranks, [*keys, value], "left").select(*df.columns, out)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], **kw) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics."""
    c = cumulative(df, keys, value, **kw)
    aggs = []
    for name, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        for tag, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
    g = c.groupBy(*keys).agg(F.max("n_total").alias("_n"), *aggs)
    cols = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return g.select(*keys, *cols)


def modal_value(df: DataFrame, keys: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Most frequent non-null value per group, ties to the smaller one.

    Counted per (group, value) first, so no group's values meet in one task. `parts`: tasks that count; by
    default Spark's choice, which has as many for a large table as for a small one.
    """
    rows = df.filter(F.col(value).isNotNull())
    counts = (rows.repartition(parts, *keys, value) if parts else rows).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    kind = df.schema[value].dataType
    if isinstance(kind, T.IntegralType):
        # Count and value in one number, which a hash aggregate keeps in place: nothing is sorted.
        packed = F.expr(f"cast(_c as decimal(19, 0)) * 18446744073709551616BD + (9223372036854775807BD - cast(`{value}` as decimal(19, 0)))")
        most = F.max(packed) % F.expr("18446744073709551616BD")
        return counts.groupBy(*keys).agg((F.expr("9223372036854775807BD") - most).cast(kind).alias(out))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(out))


def roc_points(df: DataFrame, label: str, score: str, keys: list[str] | None = None, **kw) -> DataFrame:
    """One point per distinct score: rates when everything at or above it is called positive."""
    ks = keys or []
    c = _label_counts(df, label, score, ks, **kw)
    return c.select(
        *ks,
        F.col(score).alias("threshold"),
        ((F.col("pos_total") - F.col("pos_before")) / F.col("pos_total").cast("double")).alias("tpr"),
        ((F.col("neg_total") - F.col("neg_before")) / F.col("neg_total").cast("double")).alias("fpr"),
    )


def auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None, **kw) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the right order, ties half."""
    ks = keys or []
    c = _label_counts(df, label, score, ks, **kw)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return c.groupBy(*ks).agg((won / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def _label_counts(df: DataFrame, label: str, score: str, keys: list[str], **kw) -> DataFrame:
    pos = F.when(F.col(label) == 1, 1).otherwise(0)
    return cumulative(
        df.filter(F.col(label).isNotNull()), keys, score, {"pos": pos, "neg": 1 - pos}, **kw
    )
