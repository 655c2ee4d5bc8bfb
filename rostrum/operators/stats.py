"""Grouped statistics built from partial aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking


def proportion_stats(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Mean of a 0/1 column per group with count, standard error and 95 % half-width.

    Rows with a null key are left out.
    """
    out = df.dropna(subset=keys).groupBy(*keys).agg(
        F.avg(F.col(flag).cast("double")).alias("mean"), F.count(flag).alias("count")
    )
    p, n = F.col("mean"), F.col("count")
    se = F.sqrt(F.greatest(p * (1 - p) / n, F.lit(0.0)))
    return out.select(
        *keys,
        "mean",
        "count",
        se.alias("se"),
        (se * 1.96).alias("ci_95"),
        (p * 100).alias("mean_pct"),
        (se * 196.0).alias("ci_95_pct"),
    )


def mean_sd_se(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample sd, non-null n and standard error per group."""
    v = F.col(value).cast("double")
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n"))


def two_stage_mean(df: DataFrame, unit: list[str], group: list[str], value: str, out: str = "mean") -> DataFrame:
    """Mean per unit first, then the mean of the unit means per group."""
    units = df.groupBy(*unit, *[g for g in group if g not in unit]).agg(F.avg(value).alias("_m"))
    return units.groupBy(*group).agg(F.avg("_m").alias(out), F.count("_m").alias("n_units"))


def _t975(df: int) -> float:
    """97.5 % point of Student's t, by bisection on the closed-form distribution for whole df."""

    def cdf(t: float) -> float:
        theta = math.atan2(t, math.sqrt(df))
        c, s = math.cos(theta), math.sin(theta)
        term, total = (c, c) if df % 2 else (1.0, 1.0)
        if df == 1:
            total = 0.0
        for k in range(3 if df % 2 else 2, df - 1, 2):
            term *= (k - 1) / k * c * c
            total += term
        area = 2 / math.pi * (theta + s * total) if df % 2 else s * total
        return 0.5 + area / 2

    lo, hi = 0.0, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < 0.975 else (lo, mid)
    return lo


T_TABLE_MAX = 200


def t_quantile(df: Column) -> Column:
    """t(0.975, df): a literal table up to 200, an expansion in 1/df beyond."""
    table = F.array(*[F.lit(_t975(i)) for i in range(1, T_TABLE_MAX + 1)])
    z = 1.959963984540054
    d = df.cast("double")
    series = (
        F.lit(z)
        + F.lit((z**3 + z) / 4) / d
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (d * d)
        + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (d * d * d)
    )
    return F.when(df < 1, None).when(df <= T_TABLE_MAX, F.get(table, (df - 1).cast("int"))).otherwise(series)


def mean_with_ci(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cell means with a t interval; a cell of one row has an interval of no width."""
    out = mean_sd_se(df, keys, value)
    half = F.when(F.col("n") < 2, 0.0).otherwise(t_quantile(F.col("n") - 1) * F.col("se"))
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def with_total_row(table: DataFrame, label: str, sums: list[str], name: str = "Total") -> DataFrame:
    """Append one row in which the listed columns are summed over the groups."""
    total = table.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label, F.lit(name))
    return table.withColumn(label, F.col(label).cast("string")).unionByName(total, allowMissingColumns=True)


def agreed_value(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The group's value when it is complete and the same everywhere, else null."""
    same = (F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1)))
    return df.groupBy(*keys).agg(F.when(same, F.min(value)).alias(out), (~F.coalesce(same, F.lit(False))).alias("conflict"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, median, min and max; the median comes from distinct-value counts."""
    if not keys:
        return summary(df.withColumn("_all", F.lit(1)), ["_all"], value).drop("_all")
    v = F.col(value).cast("double")
    basic = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    med = ranking.quantiles(df, keys, value, {"median": 0.5})
    return basic.join(med, keys, "left")


def missing_rates(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Share of null values per column and group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in cols],
    )


def rate_table(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Rate, n and positives per group."""
    f = F.col(flag).cast("double")
    return df.groupBy(*keys).agg(F.avg(f).alias("rate"), F.count(f).alias("n"), F.sum(F.col(flag).cast("bigint")).alias("positives"))


def recombined_mean(n_a: str, mean_a: str, n_b: str, mean_b: str) -> Column:
    """Weighted mean of two parts; a missing part weighs nothing."""
    na, nb = F.coalesce(F.col(n_a), F.lit(0)), F.coalesce(F.col(n_b), F.lit(0))
    total = na * F.coalesce(F.col(mean_a), F.lit(0.0)) + nb * F.coalesce(F.col(mean_b), F.lit(0.0))
    return total / F.nullif(na + nb, F.lit(0))


def pre_post_counts(df: DataFrame, unit: str, group: list[str], year: str, flip: int) -> DataFrame:
    """Units seen before, after, and on both sides of an event year, per group."""
    units = df.groupBy(unit, *group).agg(
        F.bool_or(F.col(year) < flip).alias("pre"), F.bool_or(F.col(year) >= flip).alias("post")
    )
    return units.groupBy(*group).agg(
        F.count_if("pre").alias("n_pre"), F.count_if("post").alias("n_post"), F.count_if(F.col("pre") & F.col("post")).alias("survivors")
    )


def active_in_all(df: DataFrame, unit: str, year: str, years: list[int], k: int | None = None) -> DataFrame:
    """Rows of the window whose unit was active in exactly k of the listed years (all by default)."""
    inside = df.filter(F.col(year).isin(years))
    counts = inside.groupBy(unit).agg(F.countDistinct(year).alias("_k")).filter(F.col("_k") == (k or len(years)))
    return inside.join(counts.select(unit), unit, "left_semi")


def shares_within(df: DataFrame, keys: list[str], category: str, weight: Column | None = None) -> DataFrame:
    """Each category's share of its group's total."""
    per = df.groupBy(*keys, category).agg(F.sum(weight if weight is not None else F.lit(1)).alias("amount"))
    totals = per.groupBy(*keys).agg(F.sum("amount").alias("total"))
    return per.join(totals, keys).withColumn("share", F.col("amount") / F.nullif(F.col("total").cast("double"), F.lit(0.0)))


def histogram(df: DataFrame, value: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Counts in bins of a fixed width, labelled by the left edge."""
    ks = keys or []
    edge = (F.floor(F.col(value) / width) * F.lit(width)).alias("bin")
    return df.filter(F.col(value).isNotNull()).groupBy(*ks, edge).agg(F.count(F.lit(1)).alias("n"))


def histogram_n(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in a fixed number of equal bins between the smallest and largest value."""
    lo, hi = _range(df, value)
    step = (hi - lo) / bins
    idx = F.least(F.floor((F.col(value) - lo) / step), F.lit(bins - 1)).cast("int").alias("bin")
    return df.filter(F.col(value).isNotNull()).groupBy(idx).agg(F.count(F.lit(1)).alias("n"))


def _range(df: DataFrame, value: str) -> tuple[Column, Column]:
    return df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()


def equal_bins(df: DataFrame, value: str, bins: int, out: str) -> DataFrame:
    """Bin number 1..bins, right-closed, the lowest value in bin 1; null stays null."""
    lo, hi = _range(df, value)
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(value) - lo) / (hi - lo) * bins))).cast("int")
    return df.withColumn(out, F.when(F.col(value).isNotNull(), b))


def scaled(df: DataFrame, value: str, out: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Min-max scaling into [low, high]."""
    lo, hi = _range(df, value)
    return df.withColumn(out, (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * (high - low) + low)


def share_of_max(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) / F.nullif(df.agg(F.max(value)).scalar(), F.lit(0.0)))


def group_flag(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """1 on every row of a group in which the column is ever positive, one flag per column."""
    flags = df.groupBy(*keys).agg(*[F.max((F.col(c) > 0).cast("int")).alias(f"class_{c}") for c in cols])
    return df.join(flags, keys, "left")


# ---- tests -------------------------------------------------------------------------


def erf(x: Column) -> Column:
    """Error function for x >= 0, Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 1 - poly * F.exp(-x * x)


def z_test(p1: Column, n1: Column, p2: Column, n2: Column) -> tuple[Column, Column]:
    """Pooled two-proportion z and two-sided p; (0, 1) when it cannot be computed."""
    pool = (p1 * n1 + p2 * n2) / F.nullif(n1 + n2, F.lit(0))
    se = F.sqrt(pool * (1 - pool) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))))
    ok = F.coalesce((n1 > 0) & (n2 > 0) & (pool > 0) & (pool < 1) & (se > 0), F.lit(False))
    z = F.when(ok, (p1 - p2) / se).otherwise(0.0)
    return z, F.when(ok, 1 - erf(F.abs(z) / math.sqrt(2))).otherwise(1.0)


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def gap_test(df: DataFrame, side: str, flag: str, keys: list[str] | None = None) -> DataFrame:
    """Side 1 against side 0 of a 0/1 column: rates, difference in points, z, p and tier."""
    ks = keys or []
    f = F.col(flag).cast("double")
    one, zero = F.col(side) == 1, F.col(side) == 0
    g = df.groupBy(*ks).agg(
        F.coalesce(F.avg(F.when(one, f)), F.lit(0.0)).alias("p1"), F.count(F.when(one, f)).alias("n1"),
        F.coalesce(F.avg(F.when(zero, f)), F.lit(0.0)).alias("p0"), F.count(F.when(zero, f)).alias("n0"),
    )
    z, p = z_test(F.col("p1"), F.col("n1"), F.col("p0"), F.col("n0"))
    g = g.withColumn("gap", (F.col("p1") - F.col("p0")) * 100).withColumn("z", z).withColumn("p_value", p)
    return g.withColumn("tier", significance(F.col("p_value")))


def transition_test(df: DataFrame, before: int, after: int, majority: dict[int, str], flag: str, parties=("Democratic", "Republican")) -> DataFrame:
    """Per party: rate before and after a change of congress, p value, and whether it fits the theory.

    The theory: a party that gains the majority uses less evidence, one that loses it more.
    """
    scope = df.filter(F.col("party").isin(*parties) & F.col("congress").isin(before, after))
    f = F.col(flag).cast("double")
    b, a = F.col("congress") == before, F.col("congress") == after
    g = scope.groupBy("party").agg(
        F.coalesce(F.avg(F.when(b, f)), F.lit(0.0)).alias("p_before"), F.count(F.when(b, f)).alias("n_before"),
        F.coalesce(F.avg(F.when(a, f)), F.lit(0.0)).alias("p_after"), F.count(F.when(a, f)).alias("n_after"),
    )
    z, p = z_test(F.col("p_after"), F.col("n_after"), F.col("p_before"), F.col("n_before"))
    g = g.withColumn("change", (F.col("p_after") - F.col("p_before")) * 100).withColumn("z", z).withColumn("p_value", p)
    was, now = F.col("party") == majority[before], F.col("party") == majority[after]
    fits = F.when(now, F.col("change") < 0).otherwise(F.col("change") > 0)
    verdict = (
        F.when(was == now, "neutral")
        .when(F.col("p_value") >= 0.05, "inconclusive")
        .when(fits, "supports")
        .otherwise("contradicts")
    )
    return g.withColumn("verdict", verdict)


def line_per_group(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope, intercept and R squared of y on x per group."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )
