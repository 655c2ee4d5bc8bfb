"""Filters, joins, set operations, reshaping, top-k over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names, text
from ..operators import relational as rel
from ..operators import members, quality
from .catalog import Tables, query
from .fixtures import congress_sql, orders_c

CONG = congress_sql("o_orderdate")


def hearings(t: Tables) -> DataFrame:
    """Orders as hearings."""
    return orders_c(t).select(
        F.col("o_orderkey").alias("hearing_id"),
        "congress",
        F.when(F.col("o_orderstatus") == "O", "senate").otherwise("house").alias("chamber"),
        F.col("o_orderpriority").alias("title"),
        "o_custkey",
        "o_orderdate",
    )


HEARINGS_SQL = f"""hearings as (
  select o_orderkey as hearing_id, {CONG} as congress,
         case when o_orderstatus = 'O' then 'senate' else 'house' end as chamber,
         o_orderpriority as title, o_custkey, o_orderdate from orders)"""


@query("congress_filter", sql=f"with {HEARINGS_SQL} select hearing_id, congress from hearings where congress >= 105 and chamber = 'house'")
def congress_filter(t: Tables) -> DataFrame:
    return rel.since(hearings(t), 105, "house").select("hearing_id", "congress")


@query("congress_range", sql=f"with {HEARINGS_SQL} select hearing_id, congress, chamber from hearings where congress between 105 and 106")
def congress_range(t: Tables) -> DataFrame:
    return rel.since(hearings(t), 105, high=106).select("hearing_id", "congress", "chamber")


@query("substantial_text", sql="select doc_id from documents where length(text) > 1000")
def substantial_text(t: Tables) -> DataFrame:
    return rel.substantial(t.documents, "text", 1000).select("doc_id")


@query("view_filter", sql="select doc_id, lang, source from documents where lang in ('en', 'fr') and source in ('src1', 'src7')")
def view_filter(t: Tables) -> DataFrame:
    return rel.view(t.documents, lang=["en", "fr"], source=["src1", "src7"]).select("doc_id", "lang", "source")


@query("existing_columns", sql="select doc_id, lang from documents")
def existing_columns(t: Tables) -> DataFrame:
    return rel.existing(t.documents, ["doc_id", "speaker", "lang"])


@query("speaker_type_filter", sql="select conv_id, turn from conversations where role = 'assistant' and regexp_matches(text, '\\S')")
def speaker_type_filter(t: Tables) -> DataFrame:
    c = t.conversations.filter(F.col("role") == "assistant")
    return c.filter(text.strip(F.col("text")) != "").select("conv_id", "turn")


@query(
    "id_pattern",
    sql="""with p as (select o_orderkey, 'CHRG-' || o_orderkey || case o_orderstatus when 'O' then 'shrg' when 'F' then 'HHRG' else 'jhrg' end || o_custkey as pid from orders)
select o_orderkey, pid, regexp_matches(pid, '(?i)^CHRG-\\d+hhrg')::int as is_house from p where regexp_matches(pid, '(?i)^CHRG-\\d+(hhrg|jhrg)')""",
)
def id_pattern(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "shrg").when(F.col("o_orderstatus") == "F", "HHRG").otherwise("jhrg")
    p = t.orders.select("o_orderkey", F.concat(F.lit("CHRG-"), "o_orderkey", kind, "o_custkey").alias("pid"))
    return p.filter(dates.is_house_package(F.col("pid"), joint=True)).withColumn(
        "is_house", dates.is_house_package(F.col("pid")).cast("int")
    )


@query("drop_sentinels", sql="select event_id, event_type from events where event_type is not null and event_type not in ('error')")
def drop_sentinels(t: Tables) -> DataFrame:
    return rel.drop_sentinels(t.events, "event_type", ["error"]).select("event_id", "event_type")


@query("event_window", sql="select o_orderkey, year(o_orderdate)::bigint - 1998 as rel_year from orders where abs(year(o_orderdate) - 1998) <= 1")
def event_window(t: Tables) -> DataFrame:
    rel_year = (F.year("o_orderdate").cast("bigint") - 1998).alias("rel_year")
    return rel.around(t.orders.select("o_orderkey", rel_year), "rel_year", 1)


@query("left_lookup", sql=f"with {HEARINGS_SQL} select l_orderkey, l_linenumber, congress, chamber, title from lineitem left join hearings on hearing_id = l_orderkey")
def left_lookup(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("hearing_id"), "l_linenumber")
    out = rel.lookup_join(lines, hearings(t).select("hearing_id", "congress", "chamber", "title"), ["hearing_id"])
    return out.withColumnRenamed("hearing_id", "l_orderkey")


@query("semi", sql="select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def semi(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return rel.keep_in(lines, t.orders.filter(F.col("o_orderstatus") == "F"), "o_orderkey").withColumnRenamed(
        "o_orderkey", "l_orderkey"
    )


@query("anti", sql="select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def anti(t: Tables) -> DataFrame:
    return rel.keep_not_in(t.customer.select("c_custkey"), t.orders.filter(F.col("o_totalprice") > 300000).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("except_ids", sql="select o_orderkey from orders except select l_orderkey from lineitem where l_returnflag = 'R'")
def except_ids(t: Tables) -> DataFrame:
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").withColumnRenamed("l_orderkey", "o_orderkey")
    return rel.id_difference(t.orders, returned, "o_orderkey")


PERIODS = [(1995, 1997, "R"), (1997, 1999, "D"), (1999, 2001, "R")]
PERIODS_SQL = "periods(start_year, end_year, control) as (values (1995, 1997, 'R'), (1997, 1999, 'D'), (1999, 2001, 'R'))"


@query(
    "interval_join",
    sql=f"with {PERIODS_SQL} select o_orderkey, year(o_orderdate)::bigint as year, control from orders left join periods on year(o_orderdate) >= start_year and year(o_orderdate) < end_year",
)
def interval_join(t: Tables) -> DataFrame:
    periods = t.spark.createDataFrame(PERIODS, "start_year bigint, end_year bigint, control string")
    o = t.orders.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return rel.interval_join(o, "year", periods, "start_year", "end_year").drop("start_year", "end_year")


@query(
    "keyed_overwrite",
    sql="""select coalesce(s.s_suppkey, c.c_custkey) as id, coalesce(s.s_name, c.c_name) as name from customer c full join supplier s on c.c_custkey = s.s_suppkey""",
)
def keyed_overwrite(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return rel.ranked_union(["id"], ["name"], a, b, later_wins=True)


@query(
    "route_by_id_type",
    sql="""with o as (select o_orderkey, case when o_orderkey % 2 = 0 then 'bioguide' else 'thomas' end as id_type,
 case when o_orderkey % 2 = 0 then 'B' || o_custkey else lpad(o_custkey::varchar, 5, '0') end as member_id from orders)
select o.o_orderkey, o.id_type, o.member_id, c.c_name from o left join customer c
 on (o.id_type = 'bioguide' and o.member_id = 'B' || c.c_custkey) or (o.id_type = 'thomas' and o.member_id = lpad(c.c_custkey::varchar, 5, '0'))""",
)
def route_by_id_type(t: Tables) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    o = t.orders.select(
        "o_orderkey",
        F.when(even, "bioguide").otherwise("thomas").alias("id_type"),
        F.when(even, F.concat(F.lit("B"), "o_custkey"))
        .otherwise(names.zero_padded(F.col("o_custkey").cast("string")))
        .alias("member_id"),
    )
    look = t.customer.select(
        "c_name",
        F.concat(F.lit("B"), "c_custkey").alias("bio"),
        names.zero_padded(F.col("c_custkey").cast("string")).alias("thomas"),
    )
    return rel.route_by_id_type(o, look, "member_id", "id_type", {"bioguide": "bio", "thomas": "thomas"}).drop("bio", "thomas")


@query(
    "three_way",
    sql="""with a as (select l_orderkey k, l_linenumber n, l_returnflag a from lineitem), b as (select l_orderkey k, l_linenumber n, l_linestatus b, l_partkey pb from lineitem), c as (select l_orderkey k, l_linenumber n, l_quantity c, l_partkey pb from lineitem where l_quantity > 10),
aa as (select l_orderkey k, l_linenumber n, l_partkey pb, l_returnflag a from lineitem)
select aa.k, aa.n, aa.pb, a, b, c from aa join b using (k, n, pb) join c using (k, n, pb)""",
)
def three_way(t: Tables) -> DataFrame:
    base = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pb"),
        F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_quantity").alias("c"),
    )
    keys = ["k", "n", "pb"]
    return base.select(*keys, "a").join(base.select(*keys, "b"), keys).join(
        base.filter(F.col("c") > 10).select(*keys, "c"), keys
    )


@query("validated_join", sql="select o_orderkey, o_custkey, c_mktsegment from orders left join customer on c_custkey = o_custkey")
def validated_join(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return rel.lookup_join(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"], validate=True)


@query(
    "label_join",
    sql="""with p as (select md5(text) as key, max((n_chars % 2)::int) as predicted from documents group by 1)
select l.doc_id, l.quality, p.predicted::int as predicted from labels l join documents d using (doc_id) join p on p.key = md5(d.text)""",
)
def label_join(t: Tables) -> DataFrame:
    """Labels meet predictions on the text itself; long texts travel as digests."""
    d = t.documents.withColumn("key", F.md5("text"))
    pred = d.groupBy("key").agg(F.max(F.col("n_chars") % 2).cast("int").alias("predicted"))
    return t.labels.select("doc_id", "quality").join(d.select("doc_id", "key"), "doc_id").join(pred, "key").drop("key")


@query(
    "type_join",
    sql="""with n as (select p_brand as term, count(*)::bigint as n from part group by 1), ty(term, kind) as (values ('Brand#1', 'first'), ('Brand#2', 'second'))
select n.term, n.n, ty.kind from n left join ty using (term)""",
)
def type_join(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([("Brand#1", "first"), ("Brand#2", "second")], "term string, kind string")
    counts = t.part.groupBy(F.col("p_brand").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return rel.lookup_join(counts, kinds, ["term"], validate=True)


# ---- dates and committees -------------------------------------------------------


@query(
    "resolve_dates",
    sql=f"""with d as (select o_orderkey, {CONG} as congress, l_shipdate::date as d from orders join lineitem on l_orderkey = o_orderkey),
r as (select *, make_date(1789 + 2 * (congress - 1), 1, 3) as lo, make_date(1791 + 2 * (congress - 1), 1, 3) as hi from d)
select o_orderkey as hearing_id, coalesce(min(case when congress in (105, 106) and d >= lo and d < hi then d end), max(d))::varchar as hearing_date from r group by 1""",
)
def resolve_dates(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_orderkey").alias("hearing_id"), F.col("l_shipdate").cast("string").alias("hearing_date"))
    out = members.resolve_hearing_dates(d, hearings(t).select("hearing_id", "congress"), known=(105, 106))
    return out.select("hearing_id", F.col("hearing_date").cast("string").alias("hearing_date"))


def committees(t: Tables) -> DataFrame:
    code = (
        F.when(F.col("l_suppkey") % 4 == 0, "hsag00")
        .when(F.col("l_suppkey") % 4 == 1, "ssba00")
        .when(F.col("l_suppkey") % 4 == 2, "hsed14")
    )
    return t.lineitem.select(
        F.col("l_orderkey").alias("hearing_id"),
        code.alias("committee_code"),
        F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("Committee "), "l_partkey")).alias("committee_name"),
        F.col("l_linenumber").alias("_ord"),
        F.col("l_partkey").alias("_tie"),
    )


COMMITTEES_SQL = """committees as (
  select l_orderkey as hearing_id, case l_suppkey % 4 when 0 then 'hsag00' when 1 then 'ssba00' when 2 then 'hsed14' end as committee_code,
         case when l_partkey % 3 > 0 then 'Committee ' || l_partkey end as committee_name, l_linenumber as _ord, l_partkey as _tie from lineitem),
best as (
  select * from (select c.hearing_id, committee_code, committee_name,
    row_number() over (partition by c.hearing_id order by
      (case when (chamber = 'house' and starts_with(committee_code, 'hs')) or (chamber = 'senate' and starts_with(committee_code, 'ss')) then 1 else 0 end) desc,
      (committee_name is not null)::int desc, _ord, _tie, committee_code nulls first) as rn
    from committees c left join hearings h on h.hearing_id = c.hearing_id) where rn = 1)"""


@query("best_committee", sql=f"with {HEARINGS_SQL}, {COMMITTEES_SQL} select hearing_id, committee_code, committee_name from best")
def best_committee(t: Tables) -> DataFrame:
    return members.best_committee(committees(t), hearings(t).select("hearing_id", "chamber"), ["_ord", "_tie", "committee_code"])


@query(
    "earliest_latest",
    sql="""select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders group by 1""",
)
def earliest_latest(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    first = rel.first_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = rel.last_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@query(
    "title_key_join",
    sql=f"""with d as (select doc_id, source, lower(array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:6], ' ')) || '_' || source || '_' || coalesce(null, 'NA') as match_key from documents),
meta as (select match_key, min(doc_id) as meta_doc from d group by 1)
select d.doc_id, m.meta_doc, md5(d.match_key) as key_digest from d left join meta m using (match_key)""",
)
def title_key_join(t: Tables) -> DataFrame:
    """Metadata joined on the first six title words plus two key parts."""
    d = t.documents.select(
        "doc_id",
        names.joined_key(names.first_words(F.col("text"), 6), "source", F.lit(None).cast("string")).alias("match_key"),
    )
    meta = rel.first_by(d, ["match_key"], ["doc_id"]).withColumnRenamed("doc_id", "meta_doc")
    return rel.lookup_join(d, meta, ["match_key"]).select("doc_id", "meta_doc", F.md5("match_key").alias("key_digest"))


@query(
    "package_id",
    sql="""with h as (select o_orderkey, upper(replace('chrg-' || o_orderkey || 'hhrg.txt', '.txt', '')) as package_id from orders),
m as (select 'CHRG-' || l_orderkey || 'HHRG' as package_id, count(*)::bigint as n_items from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, package_id, n_items, (n_items is not null)::int as matched from h left join m using (package_id)""",
)
def package_id(t: Tables) -> DataFrame:
    h = t.orders.select("o_orderkey", names.package_id(F.concat(F.lit("chrg-"), "o_orderkey", F.lit("hhrg.txt"))).alias("package_id"))
    m = (
        t.lineitem.filter(F.col("l_returnflag") == "R")
        .groupBy(F.concat(F.lit("CHRG-"), "l_orderkey", F.lit("HHRG")).alias("package_id"))
        .agg(F.count(F.lit(1)).alias("n_items"))
    )
    return rel.lookup_join(h, m, ["package_id"]).withColumn("matched", F.col("n_items").isNotNull().cast("int"))


# ---- top-k, ordering, reshaping ---------------------------------------------------


@query("topk_parts", sql="select l_partkey, count(*)::bigint as count from lineitem group by 1 order by count(*) desc, l_partkey limit 20")
def topk_parts(t: Tables) -> DataFrame:
    return rel.top_k(t.lineitem, "l_partkey", 20)


@query(
    "topk_unmatched",
    sql="select p_name, count(*)::bigint as count from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 40) group by 1 order by count(*) desc, p_name limit 20",
)
def topk_unmatched(t: Tables) -> DataFrame:
    returned = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    returned = returned.withColumnRenamed("l_partkey", "p_partkey")
    return rel.top_k(rel.keep_not_in(t.part, returned, "p_partkey"), "p_name", 20)


@query(
    "rows_of_top_sources",
    sql="with k as (select source from documents group by 1 order by count(*) desc, source limit 15) select doc_id, source from documents where source in (select source from k)",
)
def rows_of_top_sources(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source")
    return rel.keep_in(d, rel.top_k(d, "source", 15), "source").select("doc_id", "source")


LEADER_SQL = """with s as (select l_suppkey, avg((l_returnflag = 'R')::int) as p, count(*)::bigint as n from lineitem group by 1),
k as (select l_suppkey, round(p * 100, 1) as pct, n from s where n >= 5)"""


@query(
    "leaderboard",
    sql=LEADER_SQL
    + """ select * from (select *, 'top' as side, row_number() over (order by pct desc, l_suppkey)::int as rank from k order by rank limit 10)
union all select * from (select *, 'bottom' as side, row_number() over (order by pct, l_suppkey)::int as rank from k order by rank limit 10)""",
)
def leaderboard(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    k = s.filter(F.col("n") >= 5).select("l_suppkey", F.round(F.col("p") * 100, 1).alias("pct"), "n")
    return rel.best_and_worst(k, "pct", ["l_suppkey"], 10)


@query("first_n", sql="select o_orderkey, o_orderdate::date::varchar as d from orders order by o_orderdate, o_orderkey limit 1000")
def first_n(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderdate", "o_orderkey").limit(1000).select(
        "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("d")
    )


@query(
    "ordered_categories",
    sql="""with r as (select p_type as category, round(avg((l_returnflag = 'R')::int), 6) as rate from lineitem join part on p_partkey = l_partkey group by 1)
select category, rate, row_number() over (order by rate desc, category)::int as place from r""",
)
def ordered_categories(t: Tables) -> DataFrame:
    """Categories in order of their rate."""
    j = t.lineitem.select("l_partkey", "l_returnflag").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    rates = j.groupBy(F.col("p_type").alias("category")).agg(
        F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("rate")
    )
    return rel.placed(rates, [F.desc("rate"), F.col("category")])


@query("ordered_master", sql="select o_orderkey, o_orderpriority, o_orderdate::date::varchar as d from orders")
def ordered_master(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").cast("string").alias("d")
    )


@query("frequency", sql="select *, row_number() over (order by count desc, p_brand)::int as place from (select p_brand, count(*)::bigint as count from part where p_brand is not null group by 1)")
def frequency(t: Tables) -> DataFrame:
    counts = t.part.filter(F.col("p_brand").isNotNull()).groupBy("p_brand").count()
    return rel.placed(counts, [F.desc("count"), F.col("p_brand")])


@query("distinct_counts", sql="select count(distinct o_custkey)::bigint as n_members, count(distinct o_orderpriority)::bigint as n_titles, count(distinct o_orderdate)::bigint as n_days from orders")
def distinct_counts(t: Tables) -> DataFrame:
    return quality.distinct_counts(t.orders, {"n_members": "o_custkey", "n_titles": "o_orderpriority", "n_days": "o_orderdate"})


@query(
    "pivot_wide",
    sql="""select l_suppkey, round(coalesce(avg(l_quantity) filter (l_returnflag = 'A'), 0), 6) as "A_qty", round(coalesce(avg(l_quantity) filter (l_returnflag = 'R'), 0), 6) as "R_qty",
 coalesce(count(*) filter (l_returnflag = 'A'), 0)::bigint as "A_n", coalesce(count(*) filter (l_returnflag = 'R'), 0)::bigint as "R_n" from lineitem where l_returnflag in ('A', 'R') group by 1""",
)
def pivot_wide(t: Tables) -> DataFrame:
    long = t.lineitem.filter(F.col("l_returnflag").isin("A", "R")).groupBy("l_suppkey", "l_returnflag").agg(
        F.round(F.avg("l_quantity"), 6).alias("q"), F.count(F.lit(1)).alias("c")
    )
    return rel.widen(long, ["l_suppkey"], "l_returnflag", ["A", "R"], {"qty": "q", "n": "c"}, fill=0)


@query(
    "unpivot_long",
    sql="select l_orderkey, l_linenumber, 'l_discount' as measure, l_discount as amount from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem",
)
def unpivot_long(t: Tables) -> DataFrame:
    cols = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rel.lengthen(cols, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "measure", "amount")


@query(
    "complete_grid",
    sql="""with n as (select o_custkey, o_orderpriority, count(*)::bigint as n from orders group by 1, 2)
select a.o_custkey, b.o_orderpriority, coalesce(n.n, 0)::bigint as n from (select distinct o_custkey from orders) a cross join (select distinct o_orderpriority from orders) b left join n using (o_custkey, o_orderpriority)""",
)
def complete_grid(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rel.complete_grid(n, "o_custkey", "o_orderpriority", rel.levels(t.orders, "o_orderpriority"), "n")
