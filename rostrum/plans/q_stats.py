"""Grouped statistics, windows, bins and tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import buckets
from ..operators import ordered, ranking, sampling, stats
from ..operators import relational as rel
from ..session import checkpoint_dir
from .catalog import Tables, query
from .fixtures import congress_sql, orders_c
from .q_text import _rounded

CONG = congress_sql("o_orderdate")
LO = "lo as (select l.*, o.*, " + CONG + " as congress, year(o_orderdate)::bigint as yr, (l_returnflag = 'R')::int as hit from lineitem l join orders o on o_orderkey = l_orderkey)"


def lines(t: Tables) -> DataFrame:
    """Lines with their order: a 0/1 outcome per row."""
    o = orders_c(t).withColumnRenamed("o_orderkey", "l_orderkey").withColumn("yr", F.year("o_orderdate").cast("bigint"))
    return t.lineitem.join(o, "l_orderkey").withColumn("hit", (F.col("l_returnflag") == "R").cast("int"))


@query("speech_score", sql="select l_orderkey, round(avg(l_extendedprice), 6) as mean, round(var_samp(l_extendedprice / 1000), 4) as var from lineitem group by 1")
def speech_score(t: Tables) -> DataFrame:
    """Mean and sample variance of predictions per speech."""
    return t.lineitem.groupBy("l_orderkey").agg(
        F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.round(F.var_samp(F.col("l_extendedprice") / 1000), 4).alias("var")
    )


@query("two_stage_mean", sql=f"with {LO}, u as (select l_orderkey, yr, o_orderpriority, avg(hit) as m from lo group by all) select yr, o_orderpriority, round(avg(m), 6) as mean, count(*)::bigint as n_units from u group by 1, 2")
def two_stage_mean(t: Tables) -> DataFrame:
    return _rounded(stats.two_stage_mean(lines(t), ["l_orderkey"], ["yr", "o_orderpriority"], "hit"))


@query("group_se", sql="select l_suppkey, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, count(l_quantity)::bigint as n, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) as se from lineitem group by 1")
def group_se(t: Tables) -> DataFrame:
    return _rounded(stats.mean_sd_se(t.lineitem, ["l_suppkey"], "l_quantity"))


_TCASE = "case n - 1 " + " ".join(f"when {i} then {stats._t975(i)!r}::double" for i in range(1, 41)) + " end"


@query(
    "t_ci",
    sql=f"""with g as (select l_orderkey, avg(l_quantity) as mean, stddev_samp(l_quantity) as sd, count(*)::bigint as n from lineitem group by 1),
h as (select *, case when n < 2 then 0 else {_TCASE} * sd / sqrt(n) end as half from g)
select l_orderkey, round(mean, 6) as mean, round(sd, 6) as sd, n, round(sd / sqrt(n), 6) as se, round(mean - half, 6) as ci_low, round(mean + half, 6) as ci_high from h""",
)
def t_ci(t: Tables) -> DataFrame:
    return _rounded(stats.mean_with_ci(t.lineitem, ["l_orderkey"], "l_quantity"))


@query(
    "totals",
    sql="""with g as (select o_orderpriority, count(*)::bigint as n_orders, count(distinct o_custkey)::bigint as n_members from orders group by 1)
select * from g union all select 'Total', sum(n_orders)::bigint, sum(n_members)::bigint from g""",
)
def totals(t: Tables) -> DataFrame:
    """Group table plus a row that sums the groups, distinct counts included."""
    g = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_members"))
    return stats.with_total_row(g, "o_orderpriority", ["n_orders", "n_members"])


@query(
    "conflict_year",
    sql=f"""with {LO}, z as (select l_partkey, case when l_linenumber = 7 then null else yr end as y from lo)
select l_partkey, case when min(y) = max(y) and count(y) = count(*) then min(y) end as year, (not coalesce(min(y) = max(y) and count(y) = count(*), false))::int as conflict from z group by 1""",
)
def conflict_year(t: Tables) -> DataFrame:
    z = lines(t).select("l_partkey", F.when(F.col("l_linenumber") != 7, F.col("yr")).alias("y"))
    return stats.agreed_value(z, ["l_partkey"], "y", "year").withColumn("conflict", F.col("conflict").cast("int"))


#: Lines whose values a task counts.
ROWS_A_TASK = 500_000


@query(
    "collapse_modes",
    sql=f"""with {LO}, c as (select l_orderkey, l_quantity::bigint as q, count(*) as n from lo group by 1, 2),
m as (select l_orderkey, arg_min(q, (-n, q)) as modal_q from c group by 1),
a as (select l_orderkey, round(avg(l_discount), 6) as mean_score, max(o_orderpriority) as priority, bool_or(l_tax > 0.07)::int as any_high from lo group by 1)
select * from a join m using (l_orderkey)""",
)
def collapse_modes(t: Tables) -> DataFrame:
    """Rows collapsed to one speech: mean, shared attribute, any-flag, modal value."""
    x = t.lineitem.select("l_orderkey", "l_discount", "l_tax", F.col("l_quantity").cast("bigint").alias("q"))
    # Lines and modes are added up together by hash, before the speech's attribute joins: no line is sorted.
    both = rel.union_all(x.drop("q"), ranking.modal_value(x, ["l_orderkey"], "q", "modal_q", 1 + t.lineitem.count() // ROWS_A_TASK))
    a = both.groupBy("l_orderkey").agg(
        F.round(F.avg("l_discount"), 6).alias("mean_score"),
        F.bool_or(F.col("l_tax") > 0.07).cast("int").alias("any_high"),
        F.max("modal_q").alias("modal_q"),
    )
    shared = t.orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.max("o_orderpriority").alias("priority"))
    return a.filter(F.col("modal_q").isNotNull()).join(shared, "l_orderkey").select("l_orderkey", "mean_score", "priority", "any_high", "modal_q")


@query("summary_stats", sql="select l_returnflag, count(*)::bigint as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as sd, round(median(l_extendedprice), 4) as median, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem group by 1")
def summary_stats(t: Tables) -> DataFrame:
    s = stats.summary(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return s.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "median")})


@query("summary_all", sql="select count(*)::bigint as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as sd, round(median(o_totalprice), 4) as median, min(o_totalprice) as min, max(o_totalprice) as max from orders")
def summary_all(t: Tables) -> DataFrame:
    s = stats.summary(t.orders, [], "o_totalprice")
    return s.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "median")})


@query(
    "missing_rates",
    sql="""with x as (select source, nullif(quality, 0) as quality, nullif(toxic, 0) as toxic from documents left join labels using (doc_id))
select source, count(*)::bigint as n, round(avg((quality is null)::int), 6) as quality_missing, round(avg((toxic is null)::int), 6) as toxic_missing from x group by 1""",
)
def missing_rates(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    x = x.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("quality", "toxic")})
    return _rounded(stats.missing_rates(x, ["source"], ["quality", "toxic"]))


@query("text_coverage", sql="with h as (select conv_id, bool_or(length(text) > 400) as has_text from conversations group by 1) select count(*)::bigint as n_hearings, count_if(not has_text)::bigint as without_text from h")
def text_coverage(t: Tables) -> DataFrame:
    h = t.conversations.groupBy("conv_id").agg(F.bool_or(F.length("text") > 400).alias("has_text"))
    return h.agg(F.count(F.lit(1)).alias("n_hearings"), F.count_if(~F.col("has_text")).alias("without_text"))


@query("cond_counts", sql=f"with {LO} select yr, count_if(o_orderstatus = 'F')::bigint as house, count_if(o_orderstatus = 'O')::bigint as senate, count(*)::bigint as n from lo group by 1")
def cond_counts(t: Tables) -> DataFrame:
    return lines(t).groupBy("yr").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("house"), F.count_if(F.col("o_orderstatus") == "O").alias("senate"), F.count(F.lit(1)).alias("n")
    )


@query("rate_table", sql=f"with {LO} select yr, round(avg(hit), 6) as rate, count(hit)::bigint as n, sum(hit)::bigint as positives from lo group by 1")
def rate_table(t: Tables) -> DataFrame:
    return _rounded(stats.rate_table(lines(t), ["yr"], "hit"))


@query("share_per_title", sql=f"with {LO} select l_orderkey, round(count_if(hit = 1) / count(*)::double, 6) as share, count(*)::bigint as n from lo group by 1")
def share_per_title(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        F.round(F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)), 6).alias("share"), F.count(F.lit(1)).alias("n")
    )


@query(
    "weighted_mean",
    sql="""with g as (select l_partkey, avg(l_quantity) filter (l_returnflag = 'R') as ma, count(*) filter (l_returnflag = 'R') as na, avg(l_quantity) filter (l_returnflag <> 'R') as mb, count(*) filter (l_returnflag <> 'R') as nb from lineitem group by 1)
select l_partkey, round((na * coalesce(ma, 0) + nb * coalesce(mb, 0)) / (na + nb), 6) as overall from g""",
)
def weighted_mean(t: Tables) -> DataFrame:
    r = F.col("l_returnflag") == "R"
    q = F.col("l_quantity")
    g = t.lineitem.groupBy("l_partkey").agg(
        F.avg(F.when(r, q)).alias("ma"), F.count(F.when(r, q)).alias("na"), F.avg(F.when(~r, q)).alias("mb"), F.count(F.when(~r, q)).alias("nb")
    )
    return g.select("l_partkey", F.round(stats.recombined_mean("na", "ma", "nb", "mb"), 6).alias("overall"))


@query(
    "bill_means",
    sql=f"""with {LO}, b as (select l_orderkey, o_orderpriority, yr, avg(hit) as m from lo group by all)
select 'priority' as by, o_orderpriority as level, round(avg(m), 6) as mean, count(*)::bigint as n from b group by 2 union all select 'year', yr::varchar, round(avg(m), 6), count(*)::bigint from b group by 2""",
)
def bill_means(t: Tables) -> DataFrame:
    """Bill-level means, then category and year means in one more pass."""
    b = lines(t).groupBy("l_orderkey", "o_orderpriority", "yr").agg(F.avg("hit").alias("m"))
    views = F.explode(
        F.array(
            F.struct(F.lit("priority").alias("by"), F.col("o_orderpriority").alias("level")),
            F.struct(F.lit("year").alias("by"), F.col("yr").cast("string").alias("level")),
        )
    )
    flat = b.select("m", views.alias("v")).select("m", "v.by", "v.level")
    return flat.groupBy("by", "level").agg(F.round(F.avg("m"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    "survivors",
    sql="""with u as (select o_custkey, o_custkey % 2 as grp, bool_or(year(o_orderdate) < 1998) as pre, bool_or(year(o_orderdate) >= 1998) as post from orders group by 1, 2)
select grp, count_if(pre)::bigint as n_pre, count_if(post)::bigint as n_post, count_if(pre and post)::bigint as survivors from u group by 1""",
)
def survivors(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", (F.col("o_custkey") % 2).alias("grp"), F.year("o_orderdate").alias("y"))
    return stats.pre_post_counts(o, "o_custkey", ["grp"], "y", 1998)


@query(
    "active_all",
    sql="""with w as (select *, year(o_orderdate) as y from orders where year(o_orderdate) in (1996, 1997, 1998, 1999)), k as (select o_custkey from w group by 1 having count(distinct y) = 4) select o_orderkey, o_custkey from w where o_custkey in (select o_custkey from k)""",
)
def active_all(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    return stats.active_in_all(o, "o_custkey", "y", [1996, 1997, 1998, 1999]).select("o_orderkey", "o_custkey")


@query(
    "category_shares",
    sql="""with p as (select l_suppkey, l_returnflag, sum(l_quantity) as amount from lineitem group by 1, 2) select l_suppkey, l_returnflag, amount, sum(amount) over (partition by l_suppkey) as total, round(amount / sum(amount) over (partition by l_suppkey), 6) as share from p""",
)
def category_shares(t: Tables) -> DataFrame:
    return _rounded(stats.shares_within(t.lineitem, ["l_suppkey"], "l_returnflag", F.col("l_quantity")))


@query("share_of_total", sql="with p as (select lang, source, count(*)::bigint as amount from documents group by 1, 2) select lang, source, amount, (sum(amount) over (partition by lang))::bigint as total, round(amount / sum(amount) over (partition by lang)::double, 6) as share from p")
def share_of_total(t: Tables) -> DataFrame:
    return _rounded(stats.shares_within(t.documents, ["lang"], "source"))


@query("pass_rate", sql="select p_type, count(*)::bigint as n, round(avg((l_returnflag = 'R')::int), 6) as pass_rate from lineitem join part on p_partkey = l_partkey group by 1")
def pass_rate(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    j = t.lineitem.select("l_partkey", "l_returnflag").join(p, "l_partkey")
    return j.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("pass_rate"))


@query("quantiles", sql="select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem group by 1")
def quantiles(t: Tables) -> DataFrame:
    q = ranking.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p90": 0.9}, sample=5_000)
    return q.withColumns({c: F.round(c, 4) for c in ("p10", "p90")})


@query("histogram", sql="select l_returnflag, floor(l_quantity / 5.0::double) * 5.0::double as bin, count(*)::bigint as n from lineitem group by 1, 2")
def histogram(t: Tables) -> DataFrame:
    return stats.histogram(t.lineitem, "l_quantity", 5.0, ["l_returnflag"])


@query(
    "histogram_n",
    sql="""with r as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) select least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*)::bigint as n from lineitem, r group by 1""",
)
def histogram_n(t: Tables) -> DataFrame:
    return stats.histogram_n(t.lineitem, "l_extendedprice", 20)


@query("state_rates", sql="select c_nationkey, round(avg((o_orderstatus = 'F')::int) * 100, 2) as pct, count(*)::bigint as n from orders join customer on c_custkey = o_custkey group by 1 having count(*) >= 15")
def state_rates(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    g = t.orders.join(c, "o_custkey").groupBy("c_nationkey").agg(
        F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")) * 100, 2).alias("pct"), F.count(F.lit(1)).alias("n")
    )
    return g.filter(F.col("n") >= 15)


@query("corr_mae", sql="select round(corr(l_discount, l_tax), 6) as corr, round(avg(abs(l_discount - l_tax)), 6) as mae, count(*)::bigint as n from lineitem")
def corr_mae(t: Tables) -> DataFrame:
    return t.lineitem.agg(
        F.round(F.corr("l_discount", "l_tax"), 6).alias("corr"),
        F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 6).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )


@query("kpi_means", sql="select round(avg(l_discount) * 100, 6) as mean_score, round(avg((l_suppkey % 2 = 0)::int) * 100, 6) as female_share from lineitem")
def kpi_means(t: Tables) -> DataFrame:
    return t.lineitem.agg(
        F.round(F.avg("l_discount") * 100, 6).alias("mean_score"),
        F.round(F.avg((F.col("l_suppkey") % 2 == 0).cast("double")) * 100, 6).alias("female_share"),
    )


# ---- windows -------------------------------------------------------------------------


@query(
    "lag_change",
    sql="""with n as (select event_id, user_id, value, row_number() over (partition by user_id order by event_id) as rn from events)
select event_id, user_id, lag(value) over w as previous, round(value - lag(value) over w, 6) as change from n window w as (partition by user_id order by rn)""",
)
def lag_change(t: Tables) -> DataFrame:
    """Previous score and first difference per hearing, hot hearings in blocks."""
    x = ordered.with_ordered(t.events, ["user_id"], "event_id", span=1 << 16, lag={"previous": "value"})
    return x.select("event_id", "user_id", "previous", F.round(F.col("value") - F.col("previous"), 6).alias("change"))


@query("renumber", sql="select event_id, user_id, row_number() over (partition by user_id order by event_id) as rownumber from events")
def renumber(t: Tables) -> DataFrame:
    return ordered.with_ordered(t.events, ["user_id"], "event_id", span=1 << 16, number="rownumber").select("event_id", "user_id", "rownumber")


@query(
    "neighbours",
    sql="""select event_id, event_type, lag(value) over w as previous, lead(value) over w as following, row_number() over w as rownumber,
 last_value(case when value > 20 then value end ignore nulls) over (w rows between unbounded preceding and current row) as last_large from events window w as (partition by event_type order by event_id)""",
)
def neighbours(t: Tables) -> DataFrame:
    """Five hot keys cut into small blocks: neighbours, numbers and carried values across block edges."""
    x = t.events.withColumn("large", F.when(F.col("value") > 20, F.col("value")))
    out = ordered.with_ordered(
        x, ["event_type"], "event_id", span=512, lag={"previous": "value"}, lead={"following": "value"}, carry={"last_large": "large"}, number="rownumber"
    )
    return out.select("event_id", "event_type", "previous", "following", "rownumber", "last_large")


@query("group_flag", sql="select l_orderkey, l_linenumber, l_partkey, max((l_tax > 0)::int) over (partition by l_orderkey) as class_l_tax, max((l_discount > 0)::int) over (partition by l_orderkey) as class_l_discount from lineitem")
def group_flag(t: Tables) -> DataFrame:
    x = stats.group_flag(t.lineitem, ["l_orderkey"], ["l_tax", "l_discount"])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "class_l_tax", "class_l_discount")


@query("minmax_scale", sql="with r as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select o_orderkey, round((o_totalprice - lo) / (hi - lo) * 0.4::double + 0.1::double, 6) as scaled, round(o_totalprice / hi, 6) as of_max from orders, r")
def minmax_scale(t: Tables) -> DataFrame:
    o = stats.share_of_max(stats.scaled(t.orders, "o_totalprice", "scaled", 0.1, 0.5), "o_totalprice", "of_max")
    return o.select("o_orderkey", F.round("scaled", 6).alias("scaled"), F.round("of_max", 6).alias("of_max"))


# ---- bins and labels -------------------------------------------------------------------


@query("bin_equal", sql="with r as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select o_orderkey, greatest(1, least(5, ceil((o_totalprice - lo) / (hi - lo) * 5)))::int as bin from orders, r")
def bin_equal(t: Tables) -> DataFrame:
    return stats.equal_bins(t.orders, "o_totalprice", 5, "bin").select("o_orderkey", "bin")


@query("bin_custom", sql="select l_orderkey, l_linenumber, l_suppkey, case when l_quantity <= 15 then 'Marginal' when l_quantity <= 35 then 'Competitive' else 'Safe' end as margin from lineitem")
def bin_custom(t: Tables) -> DataFrame:
    margin = buckets.cut(F.col("l_quantity"), [15, 35], ["Marginal", "Competitive", "Safe"])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", margin.alias("margin"))


@query("role_labels", sql="select l_orderkey, l_linenumber, l_suppkey, case when l_linenumber % 3 = 0 then 'Ranking Member (Minority Lead)' when l_linenumber % 2 = 0 then 'Committee Chair (Majority Lead)' else 'Regular Member' end as role, case l_linestatus when 'O' then 'Open' when 'F' then 'Final' end as status from lineitem")
def role_labels(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    role = buckets.role_label((n % 2 == 0).cast("int"), (n % 3 == 0).cast("int"))
    status = buckets.mapped(F.col("l_linestatus"), {"O": "Open", "F": "Final"})
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", role.alias("role"), status.alias("status"))


@query("case_category", sql="with g as (select l_suppkey, avg((l_linenumber % 2 = 0)::int) as s from lineitem group by 1) select l_suppkey, round(s, 6) as s, case when s <= 0.10 then 'low' when s >= 0.90 then 'high' when s between 0.45 and 0.55 then 'even' else 'other' end as category, round(least(s, 1 - s), 6) as minority_prop from g")
def case_category(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.avg((F.col("l_linenumber") % 2 == 0).cast("double")).alias("s"))
    return g.select(
        "l_suppkey", F.round("s", 6).alias("s"), buckets.share_category(F.col("s")).alias("category"), F.round(buckets.minority_share(F.col("s")), 6).alias("minority_prop")
    )


@query("control_by_year", sql="select o_orderkey, case when year(o_orderdate) between 1996 and 2006 then 'R' when year(o_orderdate) between 2007 and 2010 then 'D' when year(o_orderdate) between 2011 and 2016 then 'R' end as majority, year(o_orderdate)::int - 1998 as rel_year, ((year(o_orderdate) >= 1996)::int + (year(o_orderdate) >= 1999)::int) as interval_idx from orders")
def control_by_year(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.select(
        "o_orderkey", buckets.majority_by_year(y).alias("majority"), (y - 1998).alias("rel_year"), buckets.interval_index(y, [1996, 1999]).alias("interval_idx")
    )


@query("oversight_class", sql="with s as (select doc_id, case when regexp_matches(text, '(?i)oversight|review|report|budget request|control|impact|information|investigation|request|explanation|president|administration|contract|consultation|examination') then 'oversight' else 'legislative' end as kind from documents) select doc_id, kind, (kind = 'legislative')::int as type_legislative from s")
def oversight_class(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", buckets.oversight_class(F.col("text")).alias("kind"))
    return d.withColumn("type_legislative", buckets.is_legislative(F.col("kind")))


# ---- tests -----------------------------------------------------------------------------

# The same polynomial; duckdb has no error function either.
_ERF = "(1 - ((1 / (1 + 0.3275911::double * x)) * (0.254829592::double + (1 / (1 + 0.3275911::double * x)) * (-0.284496736::double + (1 / (1 + 0.3275911::double * x)) * (1.421413741::double + (1 / (1 + 0.3275911::double * x)) * (-1.453152027::double + (1 / (1 + 0.3275911::double * x)) * 1.061405429::double))))) * exp(-x * x))"


@query(
    "ztest_gap",
    sql=f"""with {LO}, g as (select o_orderpriority, coalesce(avg(hit) filter (l_suppkey % 2 = 1), 0) as p1, count(*) filter (l_suppkey % 2 = 1) as n1, coalesce(avg(hit) filter (l_suppkey % 2 = 0), 0) as p0, count(*) filter (l_suppkey % 2 = 0) as n0 from lo group by 1),
p as (select *, (p1 * n1 + p0 * n0) / (n1 + n0) as pool from g), z as (select *, (p1 - p0) / sqrt(pool * (1 - pool) * (1.0::double / n1 + 1.0::double / n0)) as z from p), e as (select *, abs(z) / sqrt(2.0::double) as x from z), f as (select *, 1 - {_ERF} as pv from e)
select o_orderpriority, round(p1, 6) as p1, n1::bigint as n1, round(p0, 6) as p0, n0::bigint as n0, round((p1 - p0) * 100, 6) as gap, round(z, 6) as z, round(pv, 6) as p_value, case when pv < 0.001 then '***' when pv < 0.01 then '**' when pv < 0.05 then '*' else 'ns' end as tier from f""",
)
def ztest_gap(t: Tables) -> DataFrame:
    x = lines(t).withColumn("side", F.col("l_suppkey") % 2)
    return _rounded(stats.gap_test(x, "side", "hit", ["o_orderpriority"]))


@query(
    "transition_test",
    sql=f"""with {LO}, s as (select *, case when o_custkey % 2 = 0 then 'Democratic' else 'Republican' end as party from lo where congress in (105, 106)),
g as (select party, avg(hit) filter (congress = 105) as pb, count(*) filter (congress = 105) as nb, avg(hit) filter (congress = 106) as pa, count(*) filter (congress = 106) as na from s group by 1),
p as (select *, (pa * na + pb * nb) / (na + nb) as pool from g), z as (select *, (pa - pb) / sqrt(pool * (1 - pool) * (1.0::double / na + 1.0::double / nb)) as z from p), e as (select *, abs(z) / sqrt(2.0::double) as x from z), f as (select *, 1 - {_ERF} as pv from e)
select party, round(pb, 6) as p_before, nb::bigint as n_before, round(pa, 6) as p_after, na::bigint as n_after, round((pa - pb) * 100, 6) as change, round(z, 6) as z, round(pv, 6) as p_value,
 case when pv >= 0.05 then 'inconclusive' when (party = 'Republican' and pa < pb) or (party = 'Democratic' and pa > pb) then 'supports' else 'contradicts' end as verdict from f""",
)
def transition_test(t: Tables) -> DataFrame:
    x = lines(t).withColumn("party", F.when(F.col("o_custkey") % 2 == 0, "Democratic").otherwise("Republican"))
    return _rounded(stats.transition_test(x, 105, 106, {105: "Democratic", 106: "Republican"}, "hit"))


@query(
    "context_means",
    sql=f"""with {LO}, c as (select case when congress = 105 and o_custkey % 2 = 0 then 'unified minority' when congress = 105 then 'unified majority' when o_custkey % 2 = 0 then 'divided minority' else 'divided majority' end as context, l_discount as v from lo)
select context, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, count(v)::bigint as n, round(stddev_samp(v) / sqrt(count(v)), 6) as se from c group by 1""",
)
def context_means(t: Tables) -> DataFrame:
    unified, minority = F.col("congress") == 105, F.col("o_custkey") % 2 == 0
    context = F.concat_ws(" ", F.when(unified, "unified").otherwise("divided"), F.when(minority, "minority").otherwise("majority"))
    return _rounded(stats.mean_sd_se(lines(t).withColumn("context", context), ["context"], "l_discount"))


@query("regr_line", sql="select l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def regr_line(t: Tables) -> DataFrame:
    x = stats.line_per_group(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity")
    return x.select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


# ---- sampling --------------------------------------------------------------------------


@query(
    "stratified_sample",
    sql=f"""with m as (select o_orderkey, {CONG} as congress, md5('42|' || o_orderkey) as d from orders where o_custkey % 10 > 0),
r as (select *, row_number() over (partition by congress order by d) as rn from m), k as (select count(distinct congress) as k from m), q as (select r.*, 1000 // k as quota from r, k),
c as (select * from q where rn <= quota), x as (select * from q where rn > quota order by d, o_orderkey limit greatest(0, 1000 - (select count(*) from c)))
select o_orderkey, congress from c union all select o_orderkey, congress from x""",
)
def stratified_sample(t: Tables) -> DataFrame:
    m = orders_c(t).filter(F.col("o_custkey") % 10 > 0).select("o_orderkey", "congress")
    return sampling.stratified(m, "congress", ["o_orderkey"], 1000)


@query("hash_sample", sql="select event_id, event_type from events order by md5('42|' || event_id), event_id limit 500")
def hash_sample(t: Tables) -> DataFrame:
    return sampling.hash_sample(t.events.select("event_id", "event_type"), ["event_id"], 500)


@query("train_test_split", sql="select doc_id, case when ('0x' || md5('42|' || doc_id)[1:8])::bigint % 100 < 20 then 'test' else 'train' end as part from documents")
def train_test_split(t: Tables) -> DataFrame:
    train, test = sampling.split(t.documents.select("doc_id"), ["doc_id"], 20)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("block_sample", sql="select event_id, event_type, 'events.parquet' as file, 0::bigint as start from events order by md5('42|' || event_id) limit 200")
def block_sample(t: Tables) -> DataFrame:
    """Fixed number of rows from every input block; the file is smaller than a split, so it is one block."""
    return sampling.block_sample(t.events, ["event_id"], 200).select("event_id", "event_type", "block.file", "block.start")


@query("part_sample", sql="with p as (select distinct event_id % 20 as part from events), d as (select part from p order by md5('42|part=' || part) limit 5) select event_id, event_type, (event_id % 20)::int as part from events where event_id % 20 in (select part from d)")
def part_sample(t: Tables) -> DataFrame:
    """A quarter of the partitions of a table, drawn by name; the others are not read."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/parts-{uuid.uuid4().hex}"
    t.events.withColumn("part", F.col("event_id") % 20).write.partitionBy("part").parquet(path)
    return sampling.part_sample(t.spark, path, 5, whole_folders=True).select("event_id", "event_type", "part")
