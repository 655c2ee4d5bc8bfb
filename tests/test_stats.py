import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostrum.operators import labels, models, ordered, quality, ranking, sampling, stats


def test_z_test(spark):
    df = spark.createDataFrame([(0.6, 100, 0.4, 100), (0.5, 0, 0.5, 10), (0.0, 10, 0.0, 10)], "a double, n long, b double, m long")
    z, p = stats.z_test(F.col("a"), F.col("n"), F.col("b"), F.col("m"))
    rows = df.select(z.alias("z"), p.alias("p")).collect()
    assert rows[0].z == pytest.approx(2.828427, abs=1e-6) and rows[0].p == pytest.approx(0.0046777, abs=1e-6)
    assert [(r.z, r.p) for r in rows[1:]] == [(0.0, 1.0), (0.0, 1.0)]


def test_proportions(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), ("A", 1), ("A", 0), ("B", 0), ("B", 0), ("B", 0), ("B", 1), (None, 1)], "g string, x int")
    got = {r.g: r for r in stats.proportion_stats(df, ["g"], "x").collect()}
    assert set(got) == {"A", "B"} and got["A"].mean == 0.75 and got["B"]["count"] == 4
    assert got["A"].se == pytest.approx(0.216506, abs=1e-6) and got["A"].ci_95_pct == pytest.approx(42.4352, abs=1e-3)


@pytest.mark.parametrize("df,want", [(1, 12.7062), (2, 4.3027), (10, 2.2281), (30, 2.0423), (200, 1.9719)])
def test_t_quantile_table(df, want):
    assert stats._t975(df) == pytest.approx(want, abs=1e-4)
    assert models.t_sf2(want, df) == pytest.approx(0.05, abs=1e-4)


def test_t_quantile_beyond_table(spark):
    df = spark.createDataFrame([(0,), (200,), (500,)], "d int")
    got = [r[0] for r in df.select(stats.t_quantile(F.col("d"))).collect()]
    assert got[0] is None and got[1] == pytest.approx(1.97190, abs=1e-5) and got[2] == pytest.approx(1.96472, abs=1e-5)


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_blocks_give_the_plain_window_result(spark, span):
    rnd = random.Random(3)
    rows = [(k, p, rnd.choice([None, 1, 2, 5])) for k in "ab" for p in rnd.sample(range(200), 60)]
    pdf = pd.DataFrame(rows, columns=["k", "p", "v"]).sort_values(["k", "p"])
    df = spark.createDataFrame(rows, "k string, p long, v long")
    out = ordered.with_ordered(df, ["k"], "p", span=span, running={"r": "v"}, carry={"c": "v"}, lag={"l": "v"}, lead={"n": "v"}, number="i")
    got = out.orderBy("k", "p").toPandas()
    g = pdf.groupby("k").v
    same = lambda a, b: [None if pd.isna(x) else int(x) for x in a] == [None if pd.isna(x) else int(x) for x in b]
    assert same(got.r, pdf.v.fillna(0).groupby(pdf.k).cumsum()) and same(got.c, g.ffill())
    assert same(got.l, g.shift(1)) and same(got.n, g.shift(-1)) and same(got.i, g.cumcount() + 1)


@pytest.mark.parametrize("sample", [10, 100_000])
def test_ranks_and_quantiles_with_hot_group(spark, sample):
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 4 else "cold", None if i % 17 == 0 else round(rnd.gauss(0, 10), 1)) for i in range(900)]
    pdf = pd.DataFrame(rows, columns=["i", "g", "x"])
    df = spark.createDataFrame(rows, "i int, g string, x double")
    got = ranking.percent_rank_avg(df, ["g"], "x", "pr", sample=sample).orderBy("i").toPandas()
    want = pdf.groupby("g").x.rank(pct=True)
    assert np.allclose(got.pr, want, equal_nan=True)
    q = ranking.quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}, sample=sample).toPandas().set_index("g")
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.9)):
        assert np.allclose(q[name], pdf.groupby("g").x.quantile(p)[q.index])


def test_auc_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, s double")
    assert ranking.auc(df, "y", "s", sample=3).first().auc == pytest.approx(want)


def test_two_way_effects_equal_dense_regression(spark):
    rnd = np.random.default_rng(2)
    n = 400
    a, b = rnd.integers(0, 12, n), rnd.integers(0, 6, n)
    x = rnd.normal(size=n) + a * 0.3
    y = 2 * x + a - 0.5 * b + rnd.normal(size=n)
    X = np.column_stack([x, np.eye(12)[a], np.eye(6)[b][:, 1:]])
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    s2 = rss[0] / (n - X.shape[1])
    se = math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "a": a, "b": b}))
    f = models.ols_absorbed(df, "y", ["x"], ["a", "b"], tol=1e-10)
    assert f.coefficient("x") == pytest.approx(beta[0], abs=1e-6) and math.sqrt(f.vcov[0, 0]) == pytest.approx(se, rel=1e-5)


def test_event_study_and_collinear_columns(spark):
    rnd = np.random.default_rng(4)
    rows = [(m, yr, int(m % 2), float((yr >= 2007) * (m % 2) + m + 0.1 * yr + rnd.normal() * 0.01)) for m in range(20) for yr in range(2004, 2010)]
    df = spark.createDataFrame(rows, "member int, year int, dem int, y double")
    f = models.event_study(df, "y", "year", "dem", 2006, ["member", "year"], cluster="member")
    est = dict(zip(f.terms, f.beta))
    assert est["year::2004"] == pytest.approx(0, abs=0.05) and est["year::2009"] == pytest.approx(1, abs=0.05)
    two = models.ols(df.withColumn("copy", F.col("dem") * 2), "y", ["dem", "copy"])
    assert "copy" not in two.terms


def test_sample_quota_and_top_up(spark):
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") < 200, 115).otherwise(116).alias("congress"))
    s = sampling.stratified(df, "congress", ["id"], 100)
    assert {r.congress: r["count"] for r in s.groupBy("congress").count().collect()} == {115: 50, 116: 50}
    small = spark.range(105).select("id", F.when(F.col("id") < 5, 115).otherwise(116).alias("congress"))
    s = sampling.stratified(small, "congress", ["id"], 20).collect()
    assert len(s) == 20 and len({r.id for r in s}) == 20 and sum(r.congress == 115 for r in s) == 5
    assert sampling.stratified(small, "congress", ["id"], 500).count() == 105


def test_split_is_disjoint_and_repeatable(spark):
    df = spark.range(1000)
    train, test = sampling.split(df, ["id"], 20)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not a & b and len(a | b) == 1000 and 120 < len(b) < 280


def test_kappa_and_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "t int, p int")
    m = labels.binary_metrics(df, "t", "p").first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0) and m.accuracy == pytest.approx(2 / 3)
    assert labels.kappa(df, "t", "p").first().kappa == pytest.approx(0.0)


def test_quality_rules(spark):
    df = spark.createDataFrame([(0, 101.0, 2), (3, None, 1)], "seniority int, match_score double, minority int")
    rules = {k: v for k, v in quality.enriched_rules().items() if k in ("seniority_from_1", "match_score_range", "minority_binary")}
    assert {r.rule: r.broken for r in quality.violations(df, rules).collect()} == {"seniority_from_1": 1, "match_score_range": 1, "minority_binary": 1}


def test_profile_of_every_type_and_of_merged_sketches(spark):
    rows = [(1, "a" * 100, {"x": 1}, [1, 2], 0.0, None), (2, "b", {"x": 1}, [1, 2], -0.0, None), (2, None, None, [], float("nan"), None), (3, "b", {"y": 1}, None, float("nan"), None)] * 5
    df = spark.createDataFrame(rows, "i int, t string, m map<string,int>, l array<int>, d double, `odd name` string")
    p = {r.column: r for r in quality.profile(df).collect()}
    assert {c: r.n_distinct for c, r in p.items()} == {"i": 3, "t": 2, "m": 2, "l": 2, "d": 2, "odd name": 0}
    assert {c: round(r.null_share, 6) for c, r in p.items()} == {"i": 0, "t": 0.25, "m": 0.25, "l": 0.25, "d": 0, "odd name": 1}
    assert sorted(p["i"].samples) == ["1", "2", "3"] and sorted(p["t"].samples) == ["a" * 40, "b"] and p["odd name"].samples == []
    big = spark.range(30_000).select("id", (F.col("id") % 7).cast("string").alias("s"))
    halves = quality.sketches(big.filter("id < 20000")).union(quality.sketches(big.filter("id >= 15000")))
    got = {r.column: r.n_distinct for r in quality.from_sketches(halves).collect()}
    assert got["id"] == pytest.approx(30_000, rel=0.05) and got["s"] == 7
    assert quality.distinct_counts(df, {"a": "t", "b": "odd name"}).first().asDict() == {"a": 2, "b": 0}
    assert quality.profile(df.limit(0)).count() == 0


def test_required_columns_look_at_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    got = {r.column: (r.state, r.rows, r.filled) for r in quality.required_columns(df, ["a", "b", "c"]).collect()}
    assert got == {"a": ("ok", 2, 2), "b": ("empty", 2, 0), "c": ("absent", 2, 0)}
    assert {r.state for r in quality.required_columns(df.limit(0), ["a", "c"]).collect()} == {"empty", "absent"}


def test_stratified_draws_the_rows_with_the_smallest_draws(spark):
    sizes = {115: 700, 116: 40, None: 300, 117: 1}
    rows = [(c, f"{c}-{i}") for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "congress int, id string").repartition(5)

    def brute(size, seed):
        order = lambda r: hashlib.md5(f"{seed}|{r[1]}".encode()).hexdigest()
        quota, chosen, rest = size // len(sizes), [], []
        for c in sizes:
            own = sorted((r for r in rows if r[0] == c), key=order)
            chosen, rest = chosen + own[:quota], rest + own[quota:]
        return set(chosen + sorted(rest, key=order)[: size - len(chosen)])

    for size, seed in ((100, 1), (400, 42), (1_000, 7)):
        got = sampling.stratified(df, "congress", ["id"], size, seed).collect()
        assert len(got) == size and {tuple(r) for r in got} == brute(size, seed)


def test_a_threshold_that_was_too_low_is_raised(spark, monkeypatch):
    df = spark.range(3_000).select((F.col("id") % 2).alias("s"), F.col("id").cast("string").alias("k"))
    want = {r.k for r in sampling.stratified(df, "s", ["k"], 900).collect()}
    monkeypatch.setattr(sampling.math, "sqrt", lambda x: -x / 7)  # less than what is wanted
    assert {r.k for r in sampling.stratified(df, "s", ["k"], 900).collect()} == want and len(want) == 900


def test_blocks_and_files_are_sampled(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1_000).repartition(10).write.parquet(path)
    got = sampling.block_sample(spark.read.parquet(path), ["id"], 7)
    assert got.groupBy("block").count().filter("count = 7").count() == 10 and got.count() == 70
    names = sorted((p.name for p in (tmp_path / "t").glob("*.parquet")), key=lambda n: hashlib.md5(f"42|{n}".encode()).hexdigest())
    some = sampling.part_sample(spark, path, 3)
    assert {r.file for r in some.select("file").distinct().collect()} == set(names[:3]) and len(some.inputFiles()) == 3
