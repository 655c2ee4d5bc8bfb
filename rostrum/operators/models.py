"""Linear and logistic models from distributed sums.

One pass gives the k x k cross-products of the regressors, centred batch by batch; only that small matrix
reaches the driver. One fixed effect is absorbed by group means, two by solving for their levels on a
table of level pairs, so a factor with millions of levels costs groupBys and a join, not millions of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import relational as rel

#: Dummy columns that one dense solve on the driver takes; its matrix has the square of that.
MAX_DUMMIES = 400
#: Groups in which the tasks' cross-products are added up before the driver does.
MERGE = 4
_SCHEMA = "term string, estimate double, std_error double, t_value double, p_value double, conf_low double, conf_high double"


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 10_000):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + up * d), 1 + up / c
        out *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + down * d), 1 + down / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def t_sf2(t: float, df: int) -> float:
    """Two-sided tail of Student's t."""
    return _beta_tail(df / 2, 0.5, df / (df + t * t))


def t_quantile(df: int, tail: float = 0.05) -> float:
    """The value that |t| exceeds with probability `tail`."""
    lo, hi = 0.0, 1.0
    while t_sf2(hi, df) > tail:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf2(mid, df) > tail else (lo, mid)
    return hi


@dataclass
class Fit:
    """Estimates, their covariance and the degrees of freedom left."""

    spark: SparkSession
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    df: int
    r2: float

    def rows(self, beta=None, vcov=None, terms=None):
        beta, vcov, terms = self.beta if beta is None else beta, self.vcov if vcov is None else vcov, terms or self.terms
        width = t_quantile(self.df) if self.df > 0 else float("nan")
        for i, name in enumerate(terms):
            se = math.sqrt(max(vcov[i, i], 0.0))
            t = float(beta[i]) / se if se > 0 else float("nan")
            yield (name, float(beta[i]), se, t, t_sf2(t, self.df) if se > 0 else None, float(beta[i]) - width * se, float(beta[i]) + width * se)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows()), _SCHEMA)

    def combined(self, effects: dict[str, dict[str, float]]) -> DataFrame:
        """Weighted sums of coefficients with standard errors from the covariance matrix."""
        w = np.array([[e.get(t, 0.0) for t in self.terms] for e in effects.values()])
        return self.spark.createDataFrame(list(self.rows(w @ self.beta, w @ self.vcov @ w.T, list(effects))), _SCHEMA)

    def coefficient(self, term: str) -> float:
        return float(self.beta[self.terms.index(term)])

    def linear(self, values: dict[str, Column]) -> Column:
        """Prediction for columns given per term; `(Intercept)` is 1."""
        out = F.lit(0.0)
        for t, b in zip(self.terms, self.beta):
            out = out + F.lit(float(b)) * (F.lit(1.0) if t == "(Intercept)" else values[t].cast("double"))
        return out


@dataclass
class Moments:
    """Count, means and centred cross-products of some columns; two of them add up without cancellation."""

    n: int
    mean: np.ndarray
    m2: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return Moments(len(x), mean, (x - mean).T @ (x - mean))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.m2 + other.m2 + np.outer(apart, apart) * (self.n * other.n / n))

    def raw(self) -> np.ndarray:
        """Cross-products about zero."""
        return self.m2 + self.n * np.outer(self.mean, self.mean)

    def packed(self) -> list[float]:
        return [*self.mean, *self.m2[np.triu_indices(len(self.mean))]]

    @staticmethod
    def unpacked(n: int, values: np.ndarray, k: int) -> Moments:
        m2 = np.zeros((k, k))
        m2[np.triu_indices(k)] = values[k:]
        return Moments(n, values[:k].copy(), m2 + np.triu(m2, 1).T)


def moments(df: DataFrame, cols: list[str], factors: dict[str, list] | None = None) -> Moments:
    """Moments of numeric columns without nulls, and of a 0/1 column for each listed level of each factor, in one pass.

    Every Arrow batch is centred by itself and added to the task's moments; tasks' moments are added in
    MERGE groups, so what reaches the driver depends on the columns alone. Dummies exist only inside a batch.
    """
    factors = factors or {}
    k = len(cols) + sum(len(v) for v in factors.values())
    schema = "n long, packed array<double>"

    def add_up(batches: Iterator[pa.RecordBatch]):
        total = Moments(0, np.zeros(k), np.zeros((k, k)))
        for b in batches:
            for n, packed in zip(b.column("n").to_pylist(), b.column("packed")):
                total += Moments.unpacked(n, packed.values.to_numpy(), k)
        return total

    def row(total: Moments) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.n], pa.int64()), pa.array([total.packed()], pa.list_(pa.float64()))], ["n", "packed"])

    def partial(batches: Iterator[pa.RecordBatch]):
        total = Moments(0, np.zeros(k), np.zeros((k, k)))
        for b in batches:
            x = np.empty((b.num_rows, k))
            for i in range(len(cols)):
                x[:, i] = b.column(i).to_numpy(zero_copy_only=False)
            at = len(cols)
            for i, values in enumerate(factors.values()):
                codes = pc.index_in(b.column(len(cols) + i), pa.array(values, b.schema.field(len(cols) + i).type)).to_numpy(zero_copy_only=False)
                x[:, at : at + len(values)] = codes[:, None] == np.arange(len(values))
                at += len(values)
            total += Moments.of(x)
        yield row(total)

    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)], *factors).mapInArrow(partial, schema)
    merged = parts.repartition(MERGE).mapInArrow(lambda batches: iter([row(add_up(batches))]), schema)
    return add_up(iter([pa.RecordBatch.from_pylist([r.asDict() for r in merged.collect()] or [{"n": 0, "packed": [0.0] * (k + k * (k + 1) // 2)}])]))


def _independent(gram: np.ndarray, terms: list[str]) -> list[int]:
    """Indices of regressors that are not combinations of earlier ones."""
    kept: list[int] = []
    for i in range(len(terms)):
        if gram[i, i] <= 0:
            continue
        if kept:
            sub = gram[np.ix_(kept, kept)]
            coef = np.linalg.solve(sub, gram[kept, i])
            left = gram[i, i] - gram[kept, i] @ coef
            if left <= 1e-9 * gram[i, i]:
                continue
        kept.append(i)
    return kept


def _solve(spark: SparkSession, m: Moments, xs: list[str], absorbed: int = 0, intercept: bool = True) -> tuple[Fit, np.ndarray]:
    """Least squares from the moments of the regressors and, last, the outcome. With an intercept, centred ones."""
    gram = m.m2 if intercept else m.raw()
    kept = _independent(gram[:-1, :-1], xs)
    xty = gram[kept, -1]
    inv = np.linalg.inv(gram[np.ix_(kept, kept)])
    beta = inv @ xty
    rss = float(gram[-1, -1] - beta @ xty)
    terms = [xs[i] for i in kept]
    if intercept:
        mid = m.mean[kept]
        edge = -inv @ mid
        inv = np.block([[np.array([[1 / m.n - mid @ edge]]), edge[None, :]], [edge[:, None], inv]])
        beta = np.concatenate([[m.mean[-1] - mid @ beta], beta])
        terms = ["(Intercept)", *terms]
    dof = m.n - len(terms) - absorbed
    tss = float(gram[-1, -1])
    noise = rss / dof if dof > 0 else float("nan")
    return Fit(spark, terms, beta, inv * noise, m.n, dof, 1 - rss / tss if tss > 0 else float("nan")), inv


def _numeric(df: DataFrame, y: str, xs: list[str], keep: list[str]) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([y, *xs])]
    others = [F.col(c) for c in dict.fromkeys(keep) if c not in (y, *xs)]
    return df.select(*cols, *others).dropna()


def dummies(df: DataFrame, factors: list[str], limit: int = MAX_DUMMIES) -> dict[str, list]:
    """All but the first level of each factor, `limit` in all at most."""
    found = {f: rel.levels(df, f)[1:] for f in factors}
    if (n := sum(map(len, found.values()))) > limit:
        raise ValueError(f"{n} dummy columns: absorb the largest factor instead")
    return found


def ols(df: DataFrame, y: str, xs: list[str], factors: list[str] | None = None) -> Fit:
    """Least squares with an intercept and factor dummies; dependent columns are left out. One pass over the rows."""
    base = _numeric(df, y, xs, factors or [])
    found = dummies(base, factors or [])
    m = moments(base, [*xs, y], found)
    names = [*xs, *(f"{f}{level}" for f, values in found.items() for level in values)]
    order = [i for i in range(len(m.mean)) if i != len(xs)] + [len(xs)]  # the outcome last
    return _solve(df.sparkSession, Moments(m.n, m.mean[order], m.m2[np.ix_(order, order)]), names)[0]


def demean(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Subtract group means."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, by)
    rest = [c for c in df.columns if c not in cols]
    return out.select(*rest, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])


def two_way_effects(df: DataFrame, cols: list[str], effects: list[str], tol: float = 1e-10, rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """Least-squares effects of two factors on each column: (first level, _a_col...) and (second level, _b_col...).

    The rows are added up once, to counts and sums per pair of levels. The first factor is eliminated and the
    second one's equations are solved by preconditioned conjugate gradients, all columns at a time; a
    step is two sums over the pairs, and vectors are tables of levels. Rows are not touched again.
    """
    one, two = effects
    mid = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    cells = df.groupBy(F.col(one).alias("_i"), F.col(two).alias("_j")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(F.col(c) - F.lit(mid[c])).alias(f"s{k}") for k, c in enumerate(cols)])
    cells = cut_lineage(cells)
    ks = range(len(cols))
    each = lambda f: [f(k) for k in ks]
    firsts = cells.groupBy("_i").agg(F.sum("_n").alias("_ni"), *each(lambda k: F.sum(f"s{k}").alias(f"t{k}")))
    firsts = cut_lineage(firsts.select("_i", "_ni", *each(lambda k: (F.col(f"t{k}") / F.col("_ni")).alias(f"m{k}"))))
    right = cells.join(firsts, "_i").groupBy("_j").agg(F.sum("_n").alias("_nj"), *each(lambda k: F.sum(F.col(f"s{k}") - F.col("_n") * F.col(f"m{k}")).alias(f"r{k}")))
    state = cut_lineage(right.select("_j", "_nj", *each(lambda k: F.lit(0.0).alias(f"g{k}")), *each(lambda k: F.col(f"r{k}")), *each(lambda k: (F.col(f"r{k}") / F.col("_nj")).alias(f"p{k}"))))
    rz = np.array([x or 0.0 for x in state.agg(*each(lambda k: F.sum(F.col(f"r{k}") * F.col(f"p{k}")))).first()])
    spread = df.agg(*each(lambda k: (F.var_pop(cols[k]) * F.count(cols[k])).alias(f"v{k}"))).first()
    enough = np.array([tol**2 * (v or 0.0) for v in spread])
    sizes = firsts.select("_i", "_ni")
    for _ in range(rounds):
        going = rz > enough
        if not going.any():
            break
        along = cells.join(state.select("_j", *each(lambda k: F.col(f"p{k}"))), "_j").groupBy("_i").agg(*each(lambda k: F.sum(F.col("_n") * F.col(f"p{k}")).alias(f"t{k}")))
        along = along.join(sizes, "_i").select("_i", *each(lambda k: (F.col(f"t{k}") / F.col("_ni")).alias(f"t{k}")))
        back = cells.select("_i", "_j", "_n").join(along, "_i").groupBy("_j").agg(*each(lambda k: F.sum(F.col("_n") * F.col(f"t{k}")).alias(f"u{k}")))
        state = cut_lineage(state.join(back, "_j").select("_j", "_nj", *each(lambda k: F.col(f"g{k}")), *each(lambda k: F.col(f"r{k}")), *each(lambda k: F.col(f"p{k}")), *each(lambda k: (F.col("_nj") * F.col(f"p{k}") - F.col(f"u{k}")).alias(f"q{k}"))))
        products = ("p{0} * q{0}", "p{0} * r{0}", "r{0} * r{0} / _nj", "r{0} * q{0} / _nj", "q{0} * q{0} / _nj")
        pq, pr, rr, rq, qq = np.array(state.agg(*[F.sum(F.expr(e.format(k))) for e in products for k in ks]).first()).reshape(5, -1)
        # From the vectors as they are, so that rounding can slow the steps down but not lead them astray.
        step = np.where(going & (pq > 0) & (rr > enough), pr / np.where(pq > 0, pq, 1.0), 0.0)
        rz = np.where(step != 0, np.maximum(rr - 2 * step * rq + step**2 * qq, 0.0), 0.0)
        turn = rz / np.where(rr > 0, rr, 1.0)
        residual = lambda k: F.col(f"r{k}") - F.lit(float(step[k])) * F.col(f"q{k}")
        state = state.select(
            "_j", "_nj", *each(lambda k: (F.col(f"g{k}") + F.lit(float(step[k])) * F.col(f"p{k}")).alias(f"g{k}")), *each(lambda k: residual(k).alias(f"r{k}")),
            *each(lambda k: (residual(k) / F.col("_nj") + F.lit(float(turn[k])) * F.col(f"p{k}")).alias(f"p{k}")))
    else:
        raise RuntimeError(f"fixed effects did not settle in {rounds} rounds")
    seconds = cut_lineage(state.select("_j", *each(lambda k: F.col(f"g{k}"))))
    rest = cells.join(seconds, "_j").groupBy("_i").agg(F.sum("_n").alias("_ni"), *each(lambda k: F.sum(F.col(f"s{k}") - F.col("_n") * F.col(f"g{k}")).alias(f"t{k}")))
    first = rest.select(F.col("_i").alias(one), *[(F.col(f"t{k}") / F.col("_ni") + F.lit(mid[c])).alias(f"_a_{c}") for k, c in enumerate(cols)])
    return cut_lineage(first), seconds.select(F.col("_j").alias(two), *[F.col(f"g{k}").alias(f"_b_{c}") for k, c in enumerate(cols)])


def absorb(df: DataFrame, cols: list[str], effects: list[str], tol: float = 1e-10) -> DataFrame:
    """Columns without one or two sets of fixed effects; the rows are joined to the effects, never written."""
    if len(effects) == 1:
        return demean(df, cols, effects[0])
    first, second = two_way_effects(df, cols, effects, tol)
    out = df.join(first, effects[0]).join(second, effects[1])
    return out.select(*[c for c in df.columns if c not in cols], *[(F.col(c) - F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(c) for c in cols])


def ols_absorbed(df: DataFrame, y: str, xs: list[str], effects: list[str], cluster: str | None = None, tol: float = 1e-10) -> Fit:
    """Least squares with one or two absorbed fixed effects, optionally with cluster-robust errors.

    The cluster correction is G/(G-1) * (n-1)/(n-k), k counting the regressors and, for
    effects not nested in the cluster, the absorbed levels.
    """
    keep = [*effects, *([cluster] if cluster and cluster not in effects else [])]
    base = _numeric(df, y, xs, keep)
    sizes = base.agg(*[F.countDistinct(e).alias(e) for e in effects]).first()
    absorbed = sum(sizes[e] for e in effects) - (len(effects) - 1)
    effects = sorted(effects, key=lambda e: -sizes[e])  # the one with more levels is eliminated
    flat = absorb(base, [y, *xs], effects, tol)
    fit, inv = _solve(df.sparkSession, moments(flat, [*xs, y]), xs, absorbed, intercept=False)
    if cluster:
        _cluster_errors(fit, inv, flat, y, cluster, absorbed - sizes[cluster] if cluster in effects else absorbed)
    return fit


def _cluster_errors(fit: Fit, inv: np.ndarray, df: DataFrame, y: str, cluster: str, absorbed: int) -> None:
    e = F.col(y) - fit.linear({t: F.col(t) for t in fit.terms if t != "(Intercept)"})
    resid = df.withColumn("_e", e)
    one = lambda t: F.lit(1.0) if t == "(Intercept)" else F.col(t)
    scores = resid.groupBy(cluster).agg(*[F.sum(F.col("_e") * one(t)).alias(f"u{i}") for i, t in enumerate(fit.terms)])
    found = moments(scores, [f"u{i}" for i in range(len(fit.terms))])
    meat, g = found.raw(), found.n
    k = len(fit.terms) + absorbed
    fit.vcov = inv @ meat @ inv * (g / (g - 1)) * ((fit.n - 1) / (fit.n - k))
    fit.df = g - 1


def ols_clustered(df: DataFrame, y: str, xs: list[str], cluster: str) -> Fit:
    """Least squares with an intercept and cluster-robust errors."""
    base = _numeric(df, y, xs, [cluster])
    fit, inv = _solve(df.sparkSession, moments(base, [*xs, y]), xs)
    _cluster_errors(fit, inv, base, y, cluster, 0)
    return fit


def with_products(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Interaction columns a:b."""
    names = [f"{a}:{b}" for a, b in pairs]
    return df.withColumns({n: F.col(a).cast("double") * F.col(b).cast("double") for n, (a, b) in zip(names, pairs)}), names


def event_study(df: DataFrame, y: str, year: str, treated: str, reference: int, effects: list[str], cluster: str | None = None) -> Fit:
    """Treated-by-year coefficients against a reference year, with absorbed effects.

    The columns needed are written once: the levels, the effects and the moments each take a pass over the rows.
    """
    df = cut_lineage(df.select(*dict.fromkeys([y, year, treated, *effects, *([cluster] if cluster else [])])))
    years = [v for v in rel.levels(df, year) if v != reference]
    names = [f"{year}::{v}" for v in years]
    x = df.withColumns({n: ((F.col(year) == v) & (F.col(treated) == 1)).cast("double") for n, v in zip(names, years)})
    return ols_absorbed(x, y, names, effects, cluster)


def diff_in_diff(df: DataFrame, y: str, post: str, treated: str, unit: str, cluster: str | None = None) -> Fit:
    """post and post x treated with unit effects."""
    x, product = with_products(df, [(post, treated)])
    return ols_absorbed(x, y, [post, *product], [unit], cluster)


def grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """All combinations of a few listed values."""
    df = spark.range(1).select()
    for name, items in values.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in items])).alias(name))
    return df


def predict_grid(fit: Fit, values: dict[str, list], make: dict[str, Column] | None = None) -> DataFrame:
    """Predicted values on a grid; `make` builds derived terms from the grid columns."""
    g = grid(fit.spark, values)
    terms = {t: (make or {}).get(t, F.col(t) if t in values else None) for t in fit.terms if t != "(Intercept)"}
    return g.withColumn("predicted", fit.linear(terms))


def logistic(df: DataFrame, y: str, xs: list[str], max_iter: int = 100) -> DataFrame:
    """Unpenalised logistic fit: one row per term."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=xs, outputCol="_x").transform(_numeric(df, y, xs, []))
    m = LogisticRegression(featuresCol="_x", labelCol=y, regParam=0.0, maxIter=max_iter, tol=1e-10).fit(data.select("_x", y))
    rows = [("(Intercept)", float(m.intercept)), *[(x, float(c)) for x, c in zip(xs, m.coefficients)]]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")
