"""Member lookups, the matching cascade and the covariates, on stand-in hearings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from ..functions.barrier import computed_once
from ..operators import matching, members, ranking
from ..operators import relational as rel
from . import compose
from ..session import checkpoint_dir, cut_lineage
from .catalog import Tables, query
from .fixtures import congress_sql, orders_c
from .q_tables import COMMITTEES_SQL, HEARINGS_SQL, committees, hearings
from .q_text import _rounded

CONG = congress_sql("o_orderdate")
MAJORITY = {104: "Republican", 105: "Democratic", 106: "Republican"}
UNIFIED = {104: 0, 105: 1, 106: 1}

_LETTERS = ("0123456789", "aeioubdlnr")


def _bio(col):
    return F.concat(F.lit("B"), F.lpad(F.col(col).cast("string"), 6, "0"))


def _surname(col):
    return F.concat(F.lit("M"), F.translate((F.col(col) % 700 * 7919 + 1234567).cast("string"), *_LETTERS))


def member_rows(t: Tables) -> DataFrame:
    """Customers as members; surnames repeat, some parties are missing."""
    k = F.col("c_custkey")
    return t.customer.select(
        _bio("c_custkey").alias("bioguide_id"),
        _surname("c_custkey").alias("last_name"),
        F.when(k % 3 == 0, "Ann").when(k % 3 == 1, "Bob").otherwise("Cyd").alias("first_name"),
        F.when(k % 4 == 0, "Republican").when(k % 4 == 1, "Democrat").when(k % 4 == 2, "Democratic").alias("party"),
        F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("state"),
    )


def term_rows(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    return orders_c(t).select(
        _bio("o_custkey").alias("bioguide_id"),
        "congress",
        F.when(k % 10 == 0, "senate").otherwise("house").alias("chamber"),
        F.lit(None).cast("string").alias("state_code"),
    ).distinct()


def hearing_member_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("hearing_id"), _bio("l_suppkey").alias("bioguide_id")).unionByName(
        t.orders.select(F.col("o_orderkey").alias("hearing_id"), _bio("o_custkey").alias("bioguide_id"))
    )


def ideology_rows(t: Tables) -> DataFrame:
    """One row per (member, congress), some repeated, some without a score."""
    o = orders_c(t)
    k = F.col("o_custkey")
    state = F.when(k % 7 == 0, "AK").when(k % 7 == 1, "MT").otherwise(F.concat(F.lit("S"), (k % 25).cast("string")))
    return o.select(
        "congress",
        F.when(k % 10 == 0, "Senate").otherwise("House").alias("chamber"),
        _bio("o_custkey").alias("bioguide_id"),
        F.when(k % 11 > 0, ((k * 37 + F.col("congress") * 11) % 201 - 100) / F.lit(100.0)).alias("nominate_dim1"),
        (((k * 17) % 101) / F.lit(100.0)).alias("nominate_dim2"),
        state.alias("state_abbrev"),
        (k % 3).cast("int").alias("district_code"),
        F.when(k % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def leader_rows(t: Tables) -> DataFrame:
    """Committee leaders per congress, from the suppliers: one or two chairs each."""
    ag = t.supplier.groupBy((F.col("s_suppkey") % 4 + 104).cast("int").alias("congress")).agg(
        F.min(_bio("s_suppkey")).alias("lo"), F.max(_bio("s_suppkey")).alias("hi")
    )
    nested = ag.select(
        "congress", F.lit("HSAG").alias("thomas_id"), F.array("lo", "hi").alias("chair"), F.array("hi").alias("ranking_member")
    )
    return members.leaders_from_nested(nested)


def election_rows(t: Tables) -> DataFrame:
    """Lines as candidacies: one district per (customer state, number)."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    k = F.col("o_custkey")
    state = F.when(k % 7 == 0, "AK").when(k % 7 == 1, "MT").otherwise(F.concat(F.lit("S"), (k % 25).cast("string")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").join(o, "l_orderkey").select(
        "year",
        state.alias("state_po"),
        F.when(F.col("l_linenumber") == 7, "STATEWIDE").otherwise((k % 3).cast("string")).alias("district"),
        (F.col("l_extendedprice") / 1000).alias("candidatevotes"),
        F.when(F.col("l_orderkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice") + 500000).alias("totalvotes"),
    )


def sentence_rows(t: Tables) -> DataFrame:
    """Lines as spoken sentences; the line number decides how the speaker is written."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = F.col("l_linenumber")
    p = F.expr("translate(cast(l_partkey % 700 * 7919 + 1234567 as string), '0123456789', 'aeioubdlnr')")
    other = F.concat(F.lit("M"), p)
    k = F.col("l_partkey")
    first = F.when(k % 3 == 0, "Ann").when(k % 3 == 1, "Bob").otherwise("Cyd")
    speaker = (
        F.when(n == 1, F.concat(F.lit("Mr. "), _surname("o_custkey")))
        .when(n == 2, F.lit("The Chairman"))
        .when(n == 3, F.concat(F.lit("Ms. "), other))
        .when(n == 4, F.concat(F.lit("Mr. Van "), F.upper(other)))
        .when(n == 5, F.concat(F.lit("Mrs. M"), p, F.lit("z")))
        .when(n == 6, F.concat(F.lit("Mr. "), first, F.lit(" "), other))
        .otherwise(F.concat(F.lit("Dr. "), other))
    )
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(o, "l_orderkey")
    return computed_once(j, {"speaker": speaker}).select(
        F.col("l_orderkey").alias("hearing_id"),
        F.col("l_linenumber").alias("sent_no"),
        F.col("l_suppkey").alias("sent_tie"),
        "l_partkey",
        "speaker",
        "l_quantity",
    )


def sources(t: Tables) -> compose.Sources:
    if "_sources" not in t.__dict__:
        t.__dict__["_sources"] = _sources(t)
    return t.__dict__["_sources"]


def _sources(t: Tables) -> compose.Sources:
    return compose.Sources(
        hearings=hearings(t).select("hearing_id", "congress", "chamber", "title"),
        committees=committees(t),
        dates=t.lineitem.select(F.col("l_orderkey").alias("hearing_id"), F.col("l_shipdate").cast("string").alias("hearing_date")),
        members=member_rows(t),
        terms=term_rows(t),
        hearing_members=hearing_member_rows(t),
        ideology=ideology_rows(t),
        leaders=leader_rows(t),
        elections=election_rows(t),
        majority=MAJORITY,
        unified=UNIFIED,
        known_sessions=(105, 106),
        committee_order=["_ord", "_tie", "committee_code"],
    )


LET = "'0123456789', 'aeioubdlnr'"
BASE_SQL = f"""{HEARINGS_SQL}, {COMMITTEES_SQL},
members as (select 'B' || lpad(c_custkey::varchar, 6, '0') as bioguide_id, 'M' || translate((c_custkey % 700 * 7919 + 1234567)::varchar, {LET}) as last_name,
  case c_custkey % 3 when 0 then 'Ann' when 1 then 'Bob' else 'Cyd' end as first_name,
  case c_custkey % 4 when 0 then 'Republican' when 1 then 'Democrat' when 2 then 'Democratic' end as party, 'S' || c_nationkey as state from customer),
terms as (select distinct 'B' || lpad(o_custkey::varchar, 6, '0') as bioguide_id, {CONG} as congress, case when o_custkey % 10 = 0 then 'senate' else 'house' end as chamber from orders),
hm as (select l_orderkey as hearing_id, 'B' || lpad(l_suppkey::varchar, 6, '0') as bioguide_id from lineitem union all select o_orderkey, 'B' || lpad(o_custkey::varchar, 6, '0') from orders),
l1 as (select distinct bioguide_id, congress from terms where chamber = 'house'),
l2 as (select distinct bioguide_id, congress from hm join hearings using (hearing_id)),
ideo as (select {CONG} as congress, case when o_custkey % 10 = 0 then 'Senate' else 'House' end as chamber, 'B' || lpad(o_custkey::varchar, 6, '0') as bioguide_id,
  case when o_custkey % 11 > 0 then ((o_custkey * 37 + {CONG} * 11) % 201 - 100) / 100.0::double end as nominate_dim1, ((o_custkey * 17) % 101) / 100.0::double as nominate_dim2,
  case o_custkey % 7 when 0 then 'AK' when 1 then 'MT' else 'S' || (o_custkey % 25) end as state_abbrev, (o_custkey % 3)::int as district_code,
  case when o_custkey % 2 = 0 then 'F' else 'M' end as gender from orders),
l3 as (select distinct bioguide_id, congress from ideo where chamber = 'House'),
lookup as (select bioguide_id, congress, upper(last_name) as nm, last_name, first_name, party, state from (select * from l1 union select * from l2 union select * from l3) left join members using (bioguide_id)),
hmap as (select hearing_id, bioguide_id, upper(last_name) as nm, last_name, first_name, party, state from hm left join members using (bioguide_id)),
lead_src as (select (s_suppkey % 4 + 104)::int as congress, 'HSAG' as thomas_id, min('B' || lpad(s_suppkey::varchar, 6, '0')) as lo, max('B' || lpad(s_suppkey::varchar, 6, '0')) as hi from supplier group by 1),
leaders as (select congress, thomas_id, 'chair' as role, lo as bioguide_id, 0 as ord from lead_src union all select congress, thomas_id, 'chair', hi, 1 from lead_src union all select congress, thomas_id, 'ranking_member', hi, 0 from lead_src),
sent0 as (select l_orderkey as hearing_id, l_linenumber as sent_no, l_suppkey as sent_tie, l_partkey, l_quantity, o_custkey,
  translate((l_partkey % 700 * 7919 + 1234567)::varchar, {LET}) as p, translate((o_custkey % 700 * 7919 + 1234567)::varchar, {LET}) as q,
  case l_partkey % 3 when 0 then 'Ann' when 1 then 'Bob' else 'Cyd' end as fn from lineitem join orders on o_orderkey = l_orderkey),
sent1 as (select *, case sent_no when 1 then 'Mr. M' || q when 2 then 'The Chairman' when 3 then 'Ms. M' || p when 4 then 'Mr. Van ' || upper('M' || p)
   when 5 then 'Mrs. M' || p || 'z' when 6 then 'Mr. ' || fn || ' M' || p else 'Dr. M' || p end as speaker,
   case sent_no when 1 then upper('M' || q) when 2 then 'CHAIRMAN' when 3 then upper('M' || p) when 4 then 'VAN ' || upper('M' || p)
   when 5 then upper('M' || p || 'z') when 6 then upper(fn || ' M' || p) else upper('M' || p) end as full_nm,
   case sent_no when 1 then upper('M' || q) when 2 then 'CHAIRMAN' when 3 then upper('M' || p) when 4 then upper('M' || p)
   when 5 then upper('M' || p || 'z') when 6 then upper('M' || p) else upper('M' || p) end as last_w from sent0),
meta as (select s.*, h.congress, h.chamber, h.title, b.committee_code, b.committee_name from sent1 s left join hearings h using (hearing_id) left join best b using (hearing_id)),
leg as (select * from meta where sent_no < 7)
"""

# Similarity in DuckDB: LCS by nested list_reduce, only for pairs close in length.
LCS_SQL = """list_reduce(range(1, len(a) + 1), lambda prev, i: list_reduce(range(1, len(b) + 1), lambda acc, j:
   list_append(acc, case when substr(a, i::int, 1) = substr(b, j::int, 1) then prev[j] + 1 else greatest(prev[j + 1], acc[-1]) end), [0::bigint]), list_resize([0::bigint], len(b) + 1, 0))[-1]"""

MATCH_SQL = BASE_SQL + """,
pairs as (select distinct hearing_id, full_nm, last_w, congress, committee_code from leg),
hu as (select hearing_id, nm, min(bioguide_id) as bid from hmap group by all having count(*) = 1),
cu as (select congress, nm, min(bioguide_id) as bid from lookup group by all having count(*) = 1),
ch as (select congress, thomas_id, arg_min(bioguide_id, ord) as bid from leaders where role = 'chair' group by all),
st as (select p.*, coalesce(a1.bid, a2.bid) as a_bid, case when p.full_nm = 'CHAIRMAN' then ch.bid end as c_bid, coalesce(b1.bid, b2.bid) as b_bid
  from pairs p left join hu a1 on a1.hearing_id = p.hearing_id and a1.nm = p.full_nm left join hu a2 on a2.hearing_id = p.hearing_id and a2.nm = p.last_w
  left join ch on ch.congress = p.congress and ch.thomas_id = case when length(committee_code) >= 6 and substr(committee_code, 5, 2) = '00' then upper(substr(committee_code, 1, 4)) end
  left join cu b1 on b1.congress = p.congress and b1.nm = p.full_nm left join cu b2 on b2.congress = p.congress and b2.nm = p.last_w),
op as (select distinct congress, full_nm, last_w from st where a_bid is null and c_bid is null and b_bid is null and full_nm <> 'CHAIRMAN'),
cand as (select o.congress, o.full_nm, o.last_w, l.bioguide_id, 0 as rk, list_contains(string_split(o.full_nm, ' '), upper(l.first_name)) or list_contains(string_split(o.full_nm, ' '), upper(l.first_name)[1]) as fit from op o join lookup l on l.congress = o.congress and l.nm = o.full_nm
  union all select o.congress, o.full_nm, o.last_w, l.bioguide_id, 1, list_contains(string_split(o.full_nm, ' '), upper(l.first_name)) or list_contains(string_split(o.full_nm, ' '), upper(l.first_name)[1]) from op o join lookup l on l.congress = o.congress and l.nm = o.last_w where o.last_w <> o.full_nm),
told0 as (select congress, full_nm, rk, min(bioguide_id) filter (fit) as bid from cand group by all having count(*) filter (fit) = 1 and count(*) > 1),
told as (select congress, full_nm, arg_min(bid, rk) as bid from told0 group by all),
fz as (select distinct o.congress, o.full_nm as a, l.nm as b from op o join (select distinct congress, nm from lookup) l on l.congress = o.congress
   where (o.congress, o.full_nm) not in (select (congress, full_nm) from told) and 200.0 * least(length(o.full_nm), length(l.nm)) / (length(o.full_nm) + length(l.nm)) >= 85
     and levenshtein(o.full_nm, l.nm) <= 0.15 * (length(o.full_nm) + length(l.nm)) + 1e-9),
sc as (select *, 200.0::double * (case when a = b then length(a) else """ + LCS_SQL + """ end) / (length(a) + length(b)) as score from fz),
bestf as (select congress, a, arg_min(b, (-score, b)) as b, max(score) as score from sc where score >= 85 group by 1, 2),
fuz as (select f.congress, f.a, f.score, cu.bid from bestf f join cu on cu.congress = f.congress and cu.nm = f.b),
mt as (select st.hearing_id, st.full_nm, st.committee_code, coalesce(a_bid, c_bid, b_bid, t.bid, f.bid) as bid,
   case when a_bid is not null then 'hearing_member_exact' when c_bid is not null then 'committee_chair_exact' when b_bid is not null then 'congress_exact' when t.bid is not null then 'exact_disambiguated' when f.bid is not null then 'fuzzy' end as match_type,
   case when coalesce(a_bid, c_bid, b_bid, t.bid) is not null then 100.0::double else f.score end as match_score
   from st left join told t on t.congress = st.congress and t.full_nm = st.full_nm left join fuz f on f.congress = st.congress and f.a = st.full_nm),
matched as (select g.*, mt.bid as bioguide_id, mt.match_type, mt.match_score, m.party, m.first_name as member_first_name, m.state as member_state
   from leg g left join mt on mt.hearing_id = g.hearing_id and mt.full_nm = g.full_nm and mt.committee_code is not distinct from g.committee_code left join members m on m.bioguide_id = mt.bid)
"""

KEEP_SQL = "not (full_nm = last_w and bioguide_id is null and full_nm <> 'CHAIRMAN')"


def named_sentences(t: Tables) -> DataFrame:
    return compose.with_hearing_metadata(sentence_rows(t), sources(t))


def matched_sentences(t: Tables) -> DataFrame:
    return compose.match(named_sentences(t), sources(t))


@query(
    "name_parts",
    sql=f"with {BASE_SQL} select hearing_id, sent_no, sent_tie, speaker, full_nm as speaker_last_name, last_w as speaker_last_word from sent1",
)
def name_parts(t: Tables) -> DataFrame:
    s = names.with_name_parts(sentence_rows(t))
    return s.select("hearing_id", "sent_no", "sent_tie", "speaker", "speaker_last_name", "speaker_last_word")


@query(
    "committee_code",
    sql=f"with {HEARINGS_SQL}, {COMMITTEES_SQL} select hearing_id, _ord, _tie, case when length(committee_code) >= 6 and substr(committee_code, 5, 2) = '00' then upper(substr(committee_code, 1, 4)) else '' end as thomas_id from committees",
)
def committee_code(t: Tables) -> DataFrame:
    c = committees(t)
    return c.select("hearing_id", "_ord", "_tie", names.parent_committee(F.col("committee_code")).alias("thomas_id"))


@query("terms_lookup", sql=f"with {BASE_SQL} select t.bioguide_id, t.congress, upper(last_name) as last_name_upper from l1 t left join members using (bioguide_id) where congress in (105, 106)")
def terms_lookup(t: Tables) -> DataFrame:
    look = members.lookup_from_terms(member_rows(t), term_rows(t), [105, 106])
    return look.select("bioguide_id", "congress", "last_name_upper")


@query("lookup_union", sql=f"with {BASE_SQL} select bioguide_id, congress, nm as last_name_upper, party from lookup")
def lookup_union(t: Tables) -> DataFrame:
    return compose.member_lookup(sources(t)).select("bioguide_id", "congress", "last_name_upper", "party")


@query("unique_names", sql=f"with {BASE_SQL} select congress, nm as last_name_upper, min(bioguide_id) as bioguide_id from lookup where nm is not null group by all having count(*) = 1")
def unique_names(t: Tables) -> DataFrame:
    return matching.unambiguous(compose.member_lookup(sources(t)), "congress").select("congress", "last_name_upper", "bioguide_id")


@query("hearing_member_map", sql=f"with {BASE_SQL} select hearing_id, nm as last_name_upper, min(bioguide_id) as bioguide_id from hmap where nm is not null group by all having count(*) = 1")
def hearing_member_map(t: Tables) -> DataFrame:
    s = sources(t)
    m = members.hearing_member_map(s.hearing_members, s.members)
    return matching.unambiguous(m, "hearing_id").select("hearing_id", "last_name_upper", "bioguide_id")


@query("chair_resolution", sql=f"with {MATCH_SQL} select hearing_id, congress, committee_code, c_bid as bioguide_id from st where full_nm = 'CHAIRMAN'")
def chair_resolution(t: Tables) -> DataFrame:
    s = sources(t)
    pairs = named_sentences(t).filter(F.col("speaker_last_name").isin(*names.CHAIR_NAMES)).select(*matching.PAIR).distinct()
    return matching.chairs(pairs, s.leaders, s.members).select(
        "hearing_id", "congress", "committee_code", F.col("hit.bioguide_id").alias("bioguide_id")
    )


@query("disambiguate", sql=f"with {MATCH_SQL} select congress, full_nm as speaker_last_name, bid as bioguide_id from told")
def disambiguate(t: Tables) -> DataFrame:
    """Names still open after the exact stages, told apart by first name."""
    m, look = _open_names(t)
    return matching.disambiguated(m, look).select(
        "congress", "speaker_last_name", F.col("hit.bioguide_id").alias("bioguide_id")
    )


def _open_names(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Names that the exact stages leave open, and the lookup, both written since they are read several times."""
    s = sources(t)
    sents = named_sentences(t).filter(~text.is_witness(F.col("speaker")))
    pairs = sents.select(*matching.PAIR).distinct()
    look = cut_lineage(matching.by_full_name(compose.member_lookup(s)), large=True)
    hmap = members.hearing_member_map(s.hearing_members, s.members, matching.asked_names(pairs))
    m = matching.in_hearing(pairs, hmap, "_a")
    m = matching.exact_names(m, matching.unambiguous(look, "congress"), "congress", "congress_exact", "_b")
    m = m.filter(F.col("_a").isNull() & F.col("_b").isNull() & ~F.col("speaker_last_name").isin(*names.CHAIR_NAMES))
    return cut_lineage(m.select("congress", "speaker_last_name", "speaker_last_word").distinct(), large=True), look


@query("fuzzy_match", sql=f"with {MATCH_SQL} select congress, a as speaker_last_name, round(score, 6) as match_score, bid as bioguide_id from fuz")
def fuzzy_match(t: Tables) -> DataFrame:
    open_names, look = _open_names(t)
    told = matching.disambiguated(open_names, look).drop("hit")
    rest = open_names.join(told, open_names.columns, "left_anti")
    return matching.similar_names(rest, look).select(
        "congress", "speaker_last_name", F.round("hit.match_score", 6).alias("match_score"), F.col("hit.bioguide_id").alias("bioguide_id")
    )


@query(
    "match_cascade",
    sql=f"with {MATCH_SQL} select hearing_id, sent_no, sent_tie, speaker, bioguide_id, match_type, round(match_score, 6) as match_score, party, member_state from matched",
)
def match_cascade(t: Tables) -> DataFrame:
    return matched_sentences(t).select(
        "hearing_id", "sent_no", "sent_tie", "speaker", "bioguide_id", "match_type",
        F.round("match_score", 6).alias("match_score"), "party", "member_state",
    )


@query("reclassify", sql=f"with {MATCH_SQL} select hearing_id, sent_no, sent_tie, bioguide_id from matched where {KEEP_SQL}")
def reclassify(t: Tables) -> DataFrame:
    return matching.without_late_witnesses(matched_sentences(t)).select("hearing_id", "sent_no", "sent_tie", "bioguide_id")


@query(
    "match_report",
    sql=f"with {MATCH_SQL} select coalesce(match_type, 'unmatched') as match_type, count(*)::bigint as n, round(count(*) / sum(count(*)) over ()::double, 6) as share from matched where {KEEP_SQL} group by 1",
)
def match_report(t: Tables) -> DataFrame:
    m = matching.without_late_witnesses(matched_sentences(t))
    return matching.match_report(m).withColumn("share", F.round("share", 6))


@query("low_confidence", sql=f"with {MATCH_SQL} select distinct speaker, match_score, match_type from (select speaker, round(match_score, 6) as match_score, match_type from matched where match_score > 0 and match_score < 94) order by match_score, speaker limit 50")
def low_confidence(t: Tables) -> DataFrame:
    m = matched_sentences(t).withColumn("match_score", F.round("match_score", 6))
    return matching.low_confidence(m, below=94.0)


# ---- covariates -----------------------------------------------------------------------

COV_SQL = BASE_SQL + """,
hs as (select * from ideo where chamber = 'House'),
sen as (select bioguide_id, congress, row_number() over (partition by bioguide_id order by congress) as seniority from (select distinct bioguide_id, congress from hs)),
one as (select bioguide_id, congress, any_value(nominate_dim1) as nominate_dim1, any_value(nominate_dim2) as nominate_dim2, any_value(state_abbrev) as state_abbrev, any_value(district_code) as dc, any_value(gender) as gender from hs group by 1, 2),
cov0 as (select o.*, case when state_abbrev in ('AK','DE','MT','ND','SD','VT','WY') and dc = 1 then 0 else dc end as district_code, abs(nominate_dim1) as abs_dwnom1, (gender = 'F')::int as female, s.seniority from one o join sen s using (bioguide_id, congress)),
cov as (select *, case when abs_dwnom1 is not null then ((rank() over (partition by congress order by abs_dwnom1 nulls last)) + (count(*) over (partition by congress, abs_dwnom1) - 1) / 2.0::double) / count(abs_dwnom1) over (partition by congress) end as abs_dwnom1_rs,
  ((rank() over (partition by congress order by seniority)) + (count(*) over (partition by congress, seniority) - 1) / 2.0::double) / count(*) over (partition by congress) as seniority_rs from cov0),
el as (select case o_custkey % 7 when 0 then 'AK' when 1 then 'MT' else 'S' || (o_custkey % 25) end as state_abbrev, case when l_linenumber = 7 then 0 else (o_custkey % 3)::int end as district_code, ((year(o_orderdate) - 1788) // 2 + 1)::int as congress,
  case when l_orderkey % 50 = 0 then 100.0::double else l_extendedprice / 1000 / (o_totalprice + 500000) * 100 end as share, (l_orderkey % 50 = 0)::int as imp from lineitem join orders on o_orderkey = l_orderkey),
win as (select state_abbrev, district_code, congress, max(share) as vote_pct, max(imp) as vote_imputed from el group by all)
"""


@query("seniority", sql=f"with {COV_SQL} select bioguide_id, congress, seniority::int as seniority, (seniority * seniority)::int as seniority_sq, (seniority = 1)::int as freshman from sen")
def seniority(t: Tables) -> DataFrame:
    return members.seniority(ideology_rows(t))


@query("pct_rank", sql=f"with {COV_SQL} select bioguide_id, congress, round(abs_dwnom1_rs, 6) as abs_dwnom1_rs, round(seniority_rs, 6) as seniority_rs, round(seniority_rs, 6) as seniority_sq_rs, female, district_code::int as district_code from cov")
def pct_rank(t: Tables) -> DataFrame:
    c = members.ideology_covariates(ideology_rows(t))
    rs = [F.round(f"{x}_rs", 6).alias(f"{x}_rs") for x in ("abs_dwnom1", "seniority", "seniority_sq")]
    return c.select("bioguide_id", "congress", *rs, "female", "district_code")


@query("pct_rank_large", sql="""select l_orderkey, l_linenumber, l_returnflag, l_partkey, round((rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0::double) / count(*) over (partition by l_returnflag), 6) as pr from lineitem""")
def pct_rank_large(t: Tables) -> DataFrame:
    """Ranks within three big groups, cut into value blocks."""
    cols = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_extendedprice")
    r = ranking.percent_rank_avg(cols, ["l_returnflag"], "l_extendedprice", "pr", sample=10_000)
    return r.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", F.round("pr", 6).alias("pr"))


@query("at_large", sql="select c_custkey, case when (case c_nationkey % 3 when 0 then 'AK' when 1 then 'TX' else 'MT' end) in ('AK','MT') and c_custkey % 3 = 1 then 0 else c_custkey % 3 end as district_code from customer")
def at_large(t: Tables) -> DataFrame:
    n = F.col("c_nationkey") % 3
    state = F.when(n == 0, "AK").when(n == 1, "TX").otherwise("MT")
    return t.customer.select("c_custkey", members.at_large_district(state, F.col("c_custkey") % 3).alias("district_code"))


@query("winning_share", sql=f"with {COV_SQL} select state_abbrev, district_code, congress, round(vote_pct, 6) as vote_pct, round(vote_pct * vote_pct, 4) as vote_pct_sq, vote_imputed from win")
def winning_share(t: Tables) -> DataFrame:
    w = members.winning_shares(election_rows(t))
    return w.withColumn("vote_pct_sq", F.round("vote_pct_sq", 4)).withColumn("vote_pct", F.round("vote_pct", 6))


FLAGS = """case when party is not null and congress in (104, 105, 106) then (case when party = 'Democrat' then 'Democratic' else party end <> case congress when 105 then 'Democratic' else 'Republican' end)::int end"""


@query(
    "minority_flags",
    sql=f"""with {BASE_SQL} select bioguide_id, congress, party, {FLAGS} as minority, case congress when 104 then 0 when 105 then 1 when 106 then 1 end as unified,
 {FLAGS} * case congress when 104 then 0 when 105 then 1 when 106 then 1 end as minuni, case when party is not null then (party in ('Democrat', 'Democratic'))::int end as dem from lookup""",
)
def minority_flags(t: Tables) -> DataFrame:
    look = compose.member_lookup(sources(t)).select("bioguide_id", "congress", "party")
    return members.party_flags(look, MAJORITY, UNIFIED)


@query(
    "control_flags",
    sql="""with x as (select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 0 end as dem, o_custkey % 2 as dem_maj, (o_custkey % 3 = 0)::int as divided_house, case when o_custkey % 5 > 0 then (o_custkey % 5 = 1)::int end as divided_senate from orders)
select o_orderkey, (divided_house = 0 and divided_senate = 0)::int as trifecta, (dem = 1 and dem_maj = 1)::int as dem_in_maj, (dem = 0 and dem_maj = 0)::int as rep_in_maj from x""",
)
def control_flags(t: Tables) -> DataFrame:
    """Trifecta and party-in-majority flags, with unknown parties and chambers among the rows."""
    c = F.col("o_custkey")
    x = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("dem"), (c % 2).alias("dem_maj"),
        (c % 3 == 0).cast("int").alias("divided_house"), F.when(c % 5 > 0, (c % 5 == 1).cast("int")).alias("divided_senate"))
    return members.control_flags(x).select("o_orderkey", "trifecta", "dem_in_maj", "rep_in_maj")


@query("leader_table", sql=f"with {BASE_SQL} select congress, thomas_id, role, ord::int as ord, bioguide_id from leaders where congress in (105, 106)")
def leader_table(t: Tables) -> DataFrame:
    return leader_rows(t).filter(F.col("congress").isin(105, 106))


@query(
    "leadership_flags",
    sql=f"""with {BASE_SQL}, x as (select h.hearing_id, h.bioguide_id, hearings.congress, case when committee_code = 'hsag00' then 'HSAG' else '' end as th from hm h join hearings using (hearing_id) left join best using (hearing_id))
select hearing_id, x.bioguide_id, x.congress, (c.bioguide_id is not null)::int as chairspeech, (r.bioguide_id is not null)::int as rankmemspeech, greatest((c.bioguide_id is not null)::int, (r.bioguide_id is not null)::int) as leader
from x left join (select distinct * exclude (ord) from leaders where role = 'chair') c on c.bioguide_id = x.bioguide_id and c.congress = x.congress and c.thomas_id = x.th
left join (select * from leaders where role = 'ranking_member') r on r.bioguide_id = x.bioguide_id and r.congress = x.congress and r.thomas_id = x.th""",
)
def leadership_flags(t: Tables) -> DataFrame:
    s = sources(t)
    best = members.best_committee(s.committees, s.hearings, s.committee_order)
    x = s.hearing_members.join(s.hearings.select("hearing_id", "congress"), "hearing_id").join(best, "hearing_id", "left")
    x = x.select("hearing_id", "bioguide_id", "congress", "committee_code")
    return members.leadership_flags(x, s.leaders).drop("committee_code")


ENRICHED_SQL = MATCH_SQL + "," + COV_SQL[len(BASE_SQL) + 1 :] + f""",
enriched as (
 select m.*, {FLAGS.replace('party', 'm.party').replace('congress in', 'm.congress in').replace('case congress', 'case m.congress')} as minority, c.nominate_dim1, c.seniority, c.seniority_rs, c.female, c.state_abbrev, c.district_code, w.vote_pct,
   (exists (select 1 from leaders l where l.role = 'chair' and l.bioguide_id = m.bioguide_id and l.congress = m.congress and m.committee_code = 'hsag00'))::int as chairspeech
 from matched m left join cov c on c.bioguide_id = m.bioguide_id and c.congress = m.congress
 left join win w on w.state_abbrev = c.state_abbrev and w.district_code = c.district_code and w.congress = m.congress
 where {KEEP_SQL.replace('full_nm', 'm.full_nm').replace('last_w', 'm.last_w').replace('bioguide_id', 'm.bioguide_id')} and (m.bioguide_id is null or c.nominate_dim1 is not null or c.seniority is not null))"""


@query("drop_unenriched", sql=f"with {ENRICHED_SQL} select hearing_id, sent_no, sent_tie, bioguide_id from enriched where bioguide_id is not null")
def drop_unenriched(t: Tables) -> DataFrame:
    """Matched members who are not House members leave the table."""
    s = sources(t)
    m = matching.without_late_witnesses(matched_sentences(t))
    cov = cut_lineage(members.ideology_covariates(s.ideology).select("bioguide_id", "congress", "nominate_dim1", "seniority"), large=True)
    out = matching.without_outsiders(m.join(cov, ["bioguide_id", "congress"], "left"))
    return out.filter(F.col("bioguide_id").isNotNull()).select("hearing_id", "sent_no", "sent_tie", "bioguide_id")


@query(
    "enrich_all",
    sql=f"with {ENRICHED_SQL} select hearing_id, sent_no, sent_tie, congress, committee_code, bioguide_id, match_type, party, minority, seniority::int as seniority, round(seniority_rs, 6) as seniority_rs, female, district_code::int as district_code, round(vote_pct, 6) as vote_pct, chairspeech from enriched",
)
def enrich_all(t: Tables) -> DataFrame:
    """Sentences to the enriched table, every stage composed."""
    e = compose.enrich(sentence_rows(t), sources(t))
    return e.select(
        "hearing_id", "sent_no", "sent_tie", "congress", "committee_code", "bioguide_id", "match_type", "party", "minority",
        "seniority", F.round("seniority_rs", 6).alias("seniority_rs"), "female", "district_code",
        F.round("vote_pct", 6).alias("vote_pct"), "chairspeech",
    )


@query(
    "full_pipeline",
    sql=f"""with {ENRICHED_SQL},
 cells as (select unnest([{{'item': 'match_type', 'value': coalesce(match_type, 'unmatched')}}, {{'item': 'party', 'value': coalesce(party, 'none')}},
   {{'item': 'chamber', 'value': coalesce(chamber, 'none')}}, {{'item': 'congress', 'value': coalesce(congress::varchar, 'none')}}], recursive := true) from enriched),
 counts as (select item, value, count(*)::bigint as n from cells group by 1, 2)
 select item, value, n, round(n / (select count(*) from enriched)::double, 6) as share from counts""",
)
def full_pipeline(t: Tables) -> DataFrame:
    """Transcripts to the written tables and their report, as a user runs it."""
    spoken = sentence_rows(t).filter("sent_no < 7")
    said = F.concat(F.lit("    "), "speaker", F.lit(". The member speaks about part "), "l_partkey", F.lit(" and then goes on at some length for the record of this hearing."))
    lines = spoken.select("hearing_id", F.struct("sent_no", "sent_tie", said.alias("line")).alias("x"))
    # A hearing has as many lines as its order, seven at most.
    texts = lines.groupBy("hearing_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("raw_text"))
    out = compose.run(texts, sources(t), f"{checkpoint_dir(t.spark)}/pipeline-{uuid.uuid4().hex}", sample_size=100)
    return out["report"].withColumn("share", F.round("share", 6))
