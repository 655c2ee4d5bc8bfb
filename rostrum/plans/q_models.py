"""Regressions over whole tables; the oracle is the closed form where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, stats
from .catalog import Tables, query
from .q_stats import lines


def _base(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"),
        F.col("l_orderkey").alias("bill"), F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 2).alias("post"), (F.col("l_suppkey") % 2).alias("dem"),
    )


BASE_SQL = "b as (select l_extendedprice / 1000 as y, l_quantity as x, l_suppkey as supp, l_returnflag as flag, l_orderkey as bill, (l_linenumber % 2)::double as post, (l_suppkey % 2)::double as dem from lineitem)"


@query(
    "ols_dummies",
    sql=f"""with {BASE_SQL}, g as (select *, y - avg(y) over (partition by flag) as yd, x - avg(x) over (partition by flag) as xd from b),
s as (select sum(xd * yd) / sum(xd * xd) as slope, sum(xd * xd) as sxx, sum(yd * yd) as syy, count(*) as n, count(distinct flag) as k from g), v as (select *, (syy - slope * slope * sxx) / (n - 1 - k) as s2 from s),
m as (select flag, avg(y) - slope * avg(x) as a, avg(x) as xm, count(*) as nf from b, v group by flag, slope), base as (select arg_min(a, flag) as a0, min(flag) as f0, arg_min(xm, flag) as x0, arg_min(nf, flag) as n0 from m),
r as (select 1 - s2 * (n - 1 - k) / (select var_pop(y) * count(*) from b) as r2 from v)
select term, round(estimate, 5) as estimate, round(std_error, 5) as std_error, round(r2, 6) as r2 from r, (
select '(Intercept)' as term, a0 as estimate, sqrt(s2 * (1.0 / n0 + x0 * x0 / sxx)) as std_error from base, v union all select 'x', slope, sqrt(s2 / sxx) from v
union all select 'flag' || flag, a - a0, sqrt(s2 * (1.0 / nf + 1.0 / n0 + (xm - x0) * (xm - x0) / sxx)) from m, base, v where flag <> f0)""",
)
def ols_dummies(t: Tables) -> DataFrame:
    """Least squares with factor dummies: all coefficients, their standard errors and R squared."""
    f = models.ols(_base(t), "y", ["x"], ["flag"])
    return f.table().select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"), F.round(F.lit(f.r2), 6).alias("r2"))


_ABS = "g as (select *, y - avg(y) over (partition by supp) as yd, x - avg(x) over (partition by supp) as xd from b), s as (select sum(xd * yd) / sum(xd * xd) as beta, sum(xd * xd) as sxx, sum(yd * yd) as syy, count(*) as n, count(distinct supp) as k from g)"


@query(
    "ols_absorbed",
    sql=f"with {BASE_SQL}, {_ABS} select 'x' as term, round(beta, 6) as estimate, round(sqrt((syy - beta * beta * sxx) / (n - 1 - k) / sxx), 6) as std_error from s",
)
def ols_absorbed(t: Tables) -> DataFrame:
    f = models.ols_absorbed(_base(t), "y", ["x"], ["supp"])
    return f.table().select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query(
    "ols_two_way",
    sql=f"""with {BASE_SQL}, w as (select y - avg(y) over p as y, x - avg(x) over p as x, (flag = 'N')::int - avg((flag = 'N')::int) over p as a, (flag = 'R')::int - avg((flag = 'R')::int) over p as c from b window p as (partition by supp)),
m as (select sum(x * x) xx, sum(x * y) xy, sum(y * y) yy, sum(x * a) xa, sum(x * c) xc, sum(y * a) ya, sum(y * c) yc, sum(a * a) aa, sum(a * c) ac, sum(c * c) cc, sum(a * a) * sum(c * c) - sum(a * c) * sum(a * c) as det, count(*) n from w),
r as (select n, xx - ((cc * xa - ac * xc) * xa + (aa * xc - ac * xa) * xc) / det as rxx, xy - ((cc * xa - ac * xc) * ya + (aa * xc - ac * xa) * yc) / det as rxy, yy - ((cc * ya - ac * yc) * ya + (aa * yc - ac * ya) * yc) / det as ryy from m),
k as (select count(distinct supp) + count(distinct flag) - 1 as k from b)
select 'x' as term, round(rxy / rxx, 6) as estimate, round(sqrt((ryy - rxy * rxy / rxx) / (n - 1 - k) / rxx), 6) as std_error from r, k""",
)
def ols_two_way(t: Tables) -> DataFrame:
    """Two absorbed factors, solved on the table of their level pairs."""
    f = models.ols_absorbed(_base(t), "y", ["x"], ["supp", "flag"])
    return f.table().select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


#: Year effects of either group by Gauss-Jordan elimination of the equations left after the members' means, 1998 left out.
_EVENT = """with recursive y(yr, r) as (values (1995, 1), (1996, 2), (1997, 3), (1999, 4), (2000, 5), (2001, 6)), l as (select year(o_orderdate) as yr, o_custkey % 2 as dem, o_custkey as member, l_extendedprice / 1000 as y from lineitem join orders on l_orderkey = o_orderkey),
c as (select dem, member, yr, count(*)::double as n, sum(y) as s, sum(y * y) as q from l group by all), i as (select dem, member, sum(n) as ni, sum(s) as si, sum(q) as qi from c group by all),
p as (select a.dem, a.yr as t, u.yr as u, sum(a.n * u.n / ni) as v from c a join c u on a.member = u.member join i on i.member = a.member group by all),
d as (select c.dem, yr, sum(n) as nt, sum(s - n * si / ni) as b from c join i on i.member = c.member group by all),
e as (select p.dem, t, list(case when t = u then nt else 0 end - v order by u) as a, any_value(b) as b from p join d on d.dem = p.dem and d.yr = t where t <> 1998 and u <> 1998 group by p.dem, t),
g as (
  select dem, 1 as k, list(list_concat(a, [b], [case when r = x then 1.0 else 0.0 end for x in range(1, 7)]) order by r) as m from e join y on y.yr = t group by dem
  union all
  select dem, k + 1, [case when r = k then [x / m[k][k] for x in m[k]] else [m[r][j] - m[r][k] * m[k][j] / m[k][k] for j in range(1, 14)] end for r in range(1, 7)] from g where k <= 6),
f as (select dem, y.yr, m[r][7] as gamma, m[r][7 + r] as inv from g, y where k = 7),
rss as (select sum(part) as rss from (select sum(qi - si * si / ni) as part from i union all select -sum(gamma * b) from f join d using (dem, yr))),
z as (select rss / ((select count(*) from l) - 6 - (select count(*) from i) - 6) as s2 from rss)
select 'yr::' || o.yr as term, round(o.gamma - z0.gamma, 4) as estimate, round(sqrt(s2 * (o.inv + z0.inv)), 4) as std_error
from f o join f z0 on o.yr = z0.yr and o.dem = 1 and z0.dem = 0, z"""


@query("event_study", sql=_EVENT)
def event_study(t: Tables) -> DataFrame:
    """Treated-by-year coefficients with member and year effects."""
    x = lines(t).select((F.col("l_extendedprice") / 1000).alias("y"), "yr", (F.col("o_custkey") % 2).alias("dem"), F.col("o_custkey").alias("member"))
    f = models.event_study(x, "y", "yr", "dem", 1998, ["member", "yr"])
    return f.table().select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@query(
    "two_way_clustered",
    sql="""with o as (select o_custkey as c, year(o_orderdate) as yr, o_totalprice / 1000 as v from orders where year(o_orderdate) between 1996 and 1999), k as (select c from o group by c having count(distinct yr) = 4),
b as (select c, yr, avg(v) as v, ((c % 2) * (yr >= 1998)::int)::double as x from o join k using (c) group by c, yr),
w as (select c, v - avg(v) over i - avg(v) over t + avg(v) over () as y, x - avg(x) over i - avg(x) over t + avg(x) over () as x from b window i as (partition by c), t as (partition by yr)),
s as (select sum(x * y) / sum(x * x) as beta, sum(x * x) as sxx, count(*) as n, count(distinct c) as g from w), u as (select c, sum(x * (y - beta * x)) as u from w, s group by c)
select 'x' as term, round(any_value(beta), 6) as estimate, round(sqrt(sum(u * u)) / any_value(sxx) * sqrt(any_value(g) / (any_value(g) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 4.0)), 6) as std_error from u, s""",
)
def two_way_clustered(t: Tables) -> DataFrame:
    """Member and year effects with errors clustered by member, on the members' yearly means of a balanced window."""
    o = t.orders.select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("yr"), (F.col("o_totalprice") / 1000).alias("v")).filter("yr between 1996 and 1999")
    b = stats.active_in_all(o, "c", "yr", [1996, 1997, 1998, 1999]).groupBy("c", "yr").agg(F.avg("v").alias("v"))
    x = b.withColumn("x", ((F.col("c") % 2) * (F.col("yr") >= 1998).cast("int")).cast("double"))
    f = models.ols_absorbed(x, "v", ["x"], ["c", "yr"], cluster="c")
    return f.table().select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


_DID = """w as (select supp, y - avg(y) over p as y, post - avg(post) over p as a, post * dem - avg(post * dem) over p as c from b window p as (partition by supp)),
m as (select sum(a * a) aa, sum(a * c) ac, sum(c * c) cc, sum(a * y) ay, sum(c * y) cy, sum(y * y) yy, count(*) n, count(distinct supp) k from w),
e as (select *, (cc * ay - ac * cy) / (aa * cc - ac * ac) as b1, (aa * cy - ac * ay) / (aa * cc - ac * ac) as b2, aa * cc - ac * ac as det from m),
v as (select *, (yy - b1 * ay - b2 * cy) / (n - 2 - k) as s2 from e)"""


@query("did", sql=f"with {BASE_SQL}, {_DID} select 'post' as term, round(b1, 5) as estimate, round(sqrt(s2 * cc / det), 5) as std_error from v union all select 'post:dem', round(b2, 5), round(sqrt(s2 * aa / det), 5) from v")
def did(t: Tables) -> DataFrame:
    f = models.diff_in_diff(_base(t), "y", "post", "dem", "supp")
    return f.table().select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


@query("combined_effect", sql=f"with {BASE_SQL}, {_DID} select 'treated_after' as term, round(b1 + b2, 5) as estimate, round(sqrt(s2 * (cc + aa - 2 * ac) / det), 5) as std_error from v")
def combined_effect(t: Tables) -> DataFrame:
    """Sum of two coefficients with its standard error from the covariance matrix."""
    f = models.diff_in_diff(_base(t), "y", "post", "dem", "supp")
    out = f.combined({"treated_after": {"post": 1.0, "post:dem": 1.0}})
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


@query(
    "did_active",
    sql="""with w as (select *, year(o_orderdate) as y from orders where year(o_orderdate) in (1997, 1998)), k as (select o_custkey from w group by 1 having count(distinct y) = 2),
b as (select o_totalprice / 1000 as v, (y = 1998)::double as post, (o_custkey % 2)::double as dem, o_custkey as c from w where o_custkey in (select o_custkey from k)),
d as (select c, v - avg(v) over p as y, post - avg(post) over p as a, post * dem - avg(post * dem) over p as z from b window p as (partition by c)),
m as (select sum(a * a) aa, sum(a * z) az, sum(z * z) zz, sum(a * y) ay, sum(z * y) zy from d)
select 'post' as term, round((zz * ay - az * zy) / (aa * zz - az * az), 5) as estimate from m union all select 'post:dem', round((aa * zy - az * ay) / (aa * zz - az * az), 5) from m""",
)
def did_active(t: Tables) -> DataFrame:
    """Difference in differences on members active in every year of the window."""
    o = t.orders.select((F.col("o_totalprice") / 1000).alias("v"), "o_custkey", F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 2).alias("dem"))
    o = stats.active_in_all(o, "o_custkey", "y", [1997, 1998]).withColumn("post", (F.col("y") == 1998).cast("int"))
    f = models.diff_in_diff(o, "v", "post", "dem", "o_custkey")
    return f.table().select("term", F.round("estimate", 5).alias("estimate"))


@query(
    "lpm_interact",
    sql=f"""with h as (select (l_returnflag = 'R')::int::double as h, l_quantity as x, (l_suppkey % 2) as d from lineitem), r as (select regr_slope(h, x) filter (d = 0) as s0, regr_intercept(h, x) filter (d = 0) as a0, regr_slope(h, x) filter (d = 1) as s1, regr_intercept(h, x) filter (d = 1) as a1 from h)
select '(Intercept)' as term, round(a0, 6) as estimate from r union all select 'x', round(s0, 6) from r union all select 'dem', round(a1 - a0, 6) from r union all select 'x:dem', round(s1 - s0, 6) from r""",
)
def lpm_interact(t: Tables) -> DataFrame:
    """Linear probability model with an interaction."""
    b = _base(t).withColumn("h", (F.col("flag") == "R").cast("double"))
    b, product = models.with_products(b, [("x", "dem")])
    return models.ols(b, "h", ["x", "dem", *product]).table().select("term", F.round("estimate", 6).alias("estimate"))


@query(
    "cluster_se",
    sql=f"""with {BASE_SQL}, c as (select *, x - avg(x) over () as xd, y - avg(y) over () as yd from b), s as (select sum(xd * yd) / sum(xd * xd) as beta, sum(xd * xd) as sxx, count(*) as n from c),
u as (select bill, sum(xd * (yd - beta * xd)) as u from c, s group by bill), m as (select sum(u * u) as meat, count(*) as g from u)
select 'x' as term, round(beta, 6) as estimate, round(sqrt(meat / (sxx * sxx) * (g / (g - 1)::double) * ((n - 1) / (n - 2)::double)), 6) as std_error from s, m""",
)
def cluster_se(t: Tables) -> DataFrame:
    f = models.ols_clustered(_base(t), "y", ["x"], "bill")
    return f.table().filter(F.col("term") == "x").select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query(
    "grid_predict",
    sql=f"""with {BASE_SQL}, r as (select regr_slope(y, x) as s, regr_intercept(y, x) as a from b) select v::double as x, round(a + s * v, 5) as predicted from r, (values (1), (10), (25), (50)) g(v)""",
)
def grid_predict(t: Tables) -> DataFrame:
    f = models.ols(_base(t), "y", ["x"])
    return models.predict_grid(f, {"x": [1.0, 10.0, 25.0, 50.0]}).withColumn("predicted", F.round("predicted", 5))


@query(
    "logit",
    sql="""with h as (select (l_returnflag = 'R')::int as h, (l_suppkey % 2) as d from lineitem), p as (select avg(h) filter (d = 0) as p0, avg(h) filter (d = 1) as p1 from h)
select '(Intercept)' as term, round(ln(p0 / (1 - p0)), 4) as estimate from p union all select 'dem', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) from p""",
)
def logit(t: Tables) -> DataFrame:
    b = _base(t).withColumn("h", (F.col("flag") == "R").cast("double"))
    return models.logistic(b, "h", ["dem"]).withColumn("estimate", F.round("estimate", 4))
