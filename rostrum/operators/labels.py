"""Label agreement, classifier metrics and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational as rel


def confusion(df: DataFrame, truth: str, pred: str, labels: list, keys: list[str] | None = None) -> DataFrame:
    """Counts for every (truth, prediction) pair of the listed labels, absent ones 0."""
    ks = keys or []
    counts = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*ks, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("p")) for a in labels for b in labels]))
    base = counts.select(*ks).distinct() if ks else df.sparkSession.range(1).select()
    grid = base.select(*ks, cells.alias("_x")).select(*ks, F.col("_x.t").alias(truth), F.col("_x.p").alias(pred))
    return grid.join(counts, [*ks, truth, pred], "left").fillna(0, ["n"])


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def binary_metrics(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and support per group; undefined ratios are 0."""
    t, p = F.col(truth), F.col(pred)
    g = df.filter(t.isNotNull() & p.isNotNull()).groupBy(*(keys or [])).agg(
        F.count_if((t == 1) & (p == 1)).alias("_tp"), F.count_if((t == 0) & (p == 1)).alias("_fp"),
        F.count_if((t == 1) & (p == 0)).alias("_fn"), F.count_if(t == p).alias("_ok"), F.count(F.lit(1)).alias("n"),
    )
    g = g.withColumn("accuracy", _ratio(F.col("_ok"), F.col("n")))
    g = g.withColumn("precision", _ratio(F.col("_tp"), F.col("_tp") + F.col("_fp"))).withColumn("recall", _ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")))
    g = g.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return g.withColumn("support", F.col("_tp") + F.col("_fn")).drop("_tp", "_fp", "_fn", "_ok")


def method_metrics(df: DataFrame, truth: str, methods: dict[str, str], hearing: str) -> DataFrame:
    """(method, hearing, metrics): every method on every hearing, and under a null hearing the mean over hearings.

    `methods`: {name: column of its predictions}. All methods are counted in one pass; the mean weighs hearings alike.
    """
    said = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("said")) for m, c in methods.items()]))
    long = df.filter(F.col(hearing).isNotNull()).select(F.col(hearing).alias("hearing"), F.col(truth).alias("truth"), said.alias("_x")).select("hearing", "truth", "_x.*")
    each = binary_metrics(long, "truth", "said", ["method", "hearing"])
    counted = ("n", "support")
    mean = each.groupBy("method").agg(*[(F.sum(c) if c in counted else F.avg(c)).alias(c) for c in each.columns if c not in ("method", "hearing")])
    return each.unionByName(mean, allowMissingColumns=True)


def kappa(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Cohen's kappa for any number of labels, from label counts."""
    ks = keys or []
    flat = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*ks, a, b).agg(F.count(F.lit(1)).alias("n"))
    sides = flat.select(
        *ks, "n", (F.col(a) == F.col(b)).alias("same"),
        F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("label")), F.struct(F.lit("b").alias("side"), F.col(b).alias("label")))).alias("x"),
    )
    margins = sides.groupBy(*ks, "x.label").agg(
        F.sum(F.when(F.col("x.side") == "a", F.col("n")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("x.side") == "b", F.col("n")).otherwise(0)).alias("nb"),
        F.sum(F.when((F.col("x.side") == "a") & F.col("same"), F.col("n")).otherwise(0)).alias("agree"),
    )
    total, ok = F.sum("na").cast("double"), F.sum("agree")
    chance = F.sum(F.col("na").cast("double") * F.col("nb"))
    g = margins.groupBy(*ks).agg((ok / total).alias("observed"), (chance / (total * total)).alias("expected"))
    return g.withColumn("kappa", (F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0)))


def agreement(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Percent agreement and disagreement with both raters' means."""
    same = (F.col(a) == F.col(b)).cast("double")
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(keys or [])).agg(
        (F.avg(same) * 100).alias("agree_pct"), ((1 - F.avg(same)) * 100).alias("disagree_pct"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b")
    )


def multilabel_metrics(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """Binary metrics per label from {label: (truth column, prediction column)}, in one pass."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(n).alias("label"), F.col(t).cast("int").alias("t"), F.col(p).cast("int").alias("p")) for n, (t, p) in labels.items()])
    )
    flat = df.select(cells.alias("_x")).select("_x.*")
    return binary_metrics(flat, "t", "p", ["label"])


def averaged(metrics: DataFrame, cols: list[str]) -> DataFrame:
    """Macro and support-weighted averages over labels."""
    s = F.col("support")
    macro = [F.avg(c).alias(f"macro_{c}") for c in cols]
    weighted = [_ratio(F.sum(F.col(c) * s), F.sum(s)).alias(f"weighted_{c}") for c in cols]
    return metrics.agg(*macro, *weighted)


def thresholded(probabilities, cut: float = 0.5) -> Column:
    return F.transform(probabilities, lambda p: (p > cut).cast("int"))


def disagreements(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col(flag) == 0)


def score_text(df: DataFrame, text_col: str, scorer: Callable[[pd.Series], pd.Series], cut: float = 0.5) -> DataFrame:
    """Add probability and label from a user-supplied scorer, one Arrow batch at a time."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield scorer(s).astype("float64")

    scored = df.withColumn("probability", apply(F.col(text_col)))
    return scored.withColumn("label", (F.col("probability") > cut).cast("int"))


def closest_titles(left: DataFrame, right: DataFrame, title: str, key: str, cutoff: float = 85.0) -> DataFrame:
    """Exact match on the normalized title, then the most similar title for the rest.

    right must hold unique normalized titles; ties go to the title that sorts first.
    """
    from ..functions import names
    from . import matching

    l = left.withColumn("_t", names.simple_title(F.col(title)))
    r = rel.first_by(right.select(names.simple_title(F.col(title)).alias("_t"), F.col(key).alias("matched")), ["_t"], ["matched"])
    exact = l.join(r, "_t").select(*left.columns, "matched", F.lit(100.0).alias("score"), F.lit("exact").alias("how"))
    rest = l.join(r, "_t", "left_anti")
    pairs = matching.similar_pairs(rest.select(F.col("_t").alias("_a")), r.select(F.col("_t").alias("_c")), [], "_a", "_c", cutoff)
    best = rel.first_by(pairs.withColumn("_neg", -F.col("score")), ["_a"], ["_neg", "_c"])
    close = (
        rest.join(best.select(F.col("_a").alias("_t"), "_c", "score"), "_t", "left")
        .join(r.select(F.col("_t").alias("_c"), "matched"), "_c", "left")
        .select(*left.columns, "matched", "score", F.when(F.col("matched").isNotNull(), "closest").otherwise("none").alias("how"))
    )
    return exact.unionByName(close)
