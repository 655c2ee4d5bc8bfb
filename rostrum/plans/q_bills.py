"""Bills, nested arrays, citations, participants, multi-label fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bills as b
from ..functions import dates, names
from ..operators import bills
from .catalog import Tables, query


def key():
    return F.col("o_orderkey")


def bill_docs(t: Tables) -> DataFrame:
    """Orders as nested bill documents: arrays are made inside the row."""
    party = lambda x: F.when(x % 5 == 0, None).when(x % 2 == 0, "Republican").otherwise("Democrat")

    def member(x):
        return F.struct(
            F.when(x % 3 == 0, "").otherwise(F.concat(F.lit("B"), x.cast("string"))).alias("bioguide_id"),
            F.lpad(x.cast("string"), 5, "0").alias("thomas_id"),
            party(x).alias("party"),
        )

    kind = F.when(key() % 4 == 0, "hr").when(key() % 4 == 1, "s").when(key() % 4 == 2, "hres").otherwise("sjres")
    steps = F.array(F.lit("INTRODUCED"), F.lit("REFERRED"), F.lit("PASS_OVER:HOUSE"), F.lit("ENACTED:SIGNED"))
    return t.orders.select(
        F.concat(kind, key().cast("string"), F.lit("-"), (105 + key() % 10).cast("string")).alias("bill_id"),
        F.transform(
            F.slice(steps, 1, (key() % 5).cast("int")),
            lambda s, i: F.struct(s.alias("status"), F.when((key() + i) % 3 > 0, F.concat(F.lit("d"), i.cast("string"))).alias("acted_at")),
        ).alias("actions"),
        member(F.col("o_custkey")).alias("sponsor"),
        F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: i <= F.col("o_custkey") % 6), lambda i: member(F.col("o_custkey") + i * 7)
        ).alias("cosponsors"),
    )


_M = "{{'id': case when ({x}) % 3 = 0 then lpad(({x})::varchar, 5, '0') else 'B' || ({x}) end, 'kind': case when ({x}) % 3 = 0 then 'thomas' else 'bioguide' end, 'party': case when ({x}) % 5 = 0 then null when ({x}) % 2 = 0 then 'Republican' else 'Democrat' end}}"
BILLS_SQL = f"""raw as (select o_orderkey k, o_custkey c, case o_orderkey % 4 when 0 then 'hr' when 1 then 's' when 2 then 'hres' else 'sjres' end as kind, 105 + o_orderkey % 10 as congress,
  list_filter(list_transform(range(0, least(o_orderkey % 5, 4)), lambda i: {{'i': i, 's': ['INTRODUCED','REFERRED','PASS_OVER:HOUSE','ENACTED:SIGNED'][i + 1], 'ok': (o_orderkey + i) % 3 > 0}}), lambda a: a.ok)[-1] as last,
  {_M.format(x='o_custkey')} as sponsor, list_transform(range(1, o_custkey % 6 + 1), lambda i: {_M.format(x='o_custkey + i * 7')}) as cos from orders),
bills as (select *, kind || k || '-' || congress as bill_id, congress || ' ' || case kind when 'hr' then 'H.R.' when 's' then 'S.' when 'hres' then 'H.Res.' else 'S.J.Res.' end || ' ' || k as bill_number,
  last.s as status, len(cos)::bigint as n, len(list_filter(cos, lambda x: x.party = 'Republican'))::bigint as r, len(list_filter(cos, lambda x: x.party = 'Democrat'))::bigint as d,
  case when congress in (110, 111) then 'Democrat' else 'Republican' end as maj from raw)"""


@query(
    "array_last",
    sql=f"with {BILLS_SQL} select bill_id, congress::int as congress, bill_number, status, 'd' || last.i as status_at, coalesce(status in ('PASS_OVER:HOUSE', 'ENACTED:SIGNED'), false)::int as house_pass, coalesce(status = 'ENACTED:SIGNED', false)::int as law_pass from bills",
)
def array_last(t: Tables) -> DataFrame:
    """Last dated action, bill label and pass flags."""
    return bills.bill_table(bill_docs(t)).drop("sponsor", "cosponsors")


@query("id_fallback", sql=f"with {BILLS_SQL} select bill_id, sponsor.id as member_id, sponsor.kind as id_type from bills")
def id_fallback(t: Tables) -> DataFrame:
    return bills.bill_table(bill_docs(t)).select("bill_id", "sponsor.member_id", "sponsor.id_type")


@query("array_counts", sql=f"with {BILLS_SQL} select bill_id, n as num_cosponsors, r as num_republican, d as num_democrat from bills")
def array_counts(t: Tables) -> DataFrame:
    s = bills.sponsor_scores(bills.bill_table(bill_docs(t)))
    return s.select("bill_id", "num_cosponsors", "num_republican", "num_democrat")


@query(
    "array_exists",
    sql=f"with {BILLS_SQL} select bill_id, case when sponsor.party is not null then (case when sponsor.party = 'Republican' then d else r end > 0)::int end as bipartisan from bills",
)
def array_exists(t: Tables) -> DataFrame:
    return bills.sponsor_scores(bills.bill_table(bill_docs(t))).select("bill_id", "bipartisan")


@query(
    "bill_scores",
    sql=f"""with {BILLS_SQL}, mx as (select max(ln(1 + n)) as m from bills),
x as (select *, round((case maj when 'Republican' then d else r end + (sponsor.party is distinct from maj)::int) / (n + 1)::double, 3) as intensity, case when n = 0 then 0 when sponsor.party = 'Democrat' then r / n::double when sponsor.party = 'Republican' then d / n::double else 0 end as mo from bills)
select bill_id, intensity as bipartisanship_intensity, (sponsor.party is not distinct from maj)::int as sponsor_majority, round(mo, 6) as moderation_score, round(case when n > 0 then (d - r) / n::double end, 6) as extremism_score, round(ln(1 + n) / m, 6) as log_scaled, round(mo * ln(1 + n) / m, 6) as moderation_standardized from x, mx""",
)
def bill_scores(t: Tables) -> DataFrame:
    s = bills.sponsor_scores(bills.bill_table(bill_docs(t)))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select(
        "bill_id", "bipartisanship_intensity", "sponsor_majority", r("moderation_score"), r("extremism_score"), r("log_scaled"), r("moderation_standardized")
    )


@query("unmatched_sponsors", sql=f"with {BILLS_SQL} select distinct sponsor.id as member_id from bills where sponsor.id not in (select 'B' || c_custkey from customer where c_acctbal > 0)")
def unmatched_sponsors(t: Tables) -> DataFrame:
    known = t.customer.filter(F.col("c_acctbal") > 0).select(F.concat(F.lit("B"), "c_custkey").alias("member_id"))
    return bills.unmatched_members(bills.bill_table(bill_docs(t)), known, "member_id")


@query("flatten_people", sql=f"with {BILLS_SQL} select bill_id, unnest(range(1, len(cos) + 1))::bigint as num, unnest(list_transform(cos, lambda x: x.id)) as member_id, unnest(list_transform(cos, lambda x: x.party)) as party from bills")
def flatten_people(t: Tables) -> DataFrame:
    return bills.flatten_people(bills.bill_table(bill_docs(t)), "bill_id", "cosponsors").drop("id_type")


@query(
    "number_elements",
    sql="""select o_orderkey, i::bigint as num, 'L' || i as lname, 'R' || o_custkey as role, case when i % 2 = 0 then 'P' || i end as proxy_for_lname, case when i % 2 = 0 then 'Q' || o_custkey end as proxy_for_role from orders, lateral (select unnest(range(1, 4)) as i)""",
)
def number_elements(t: Tables) -> DataFrame:
    person = lambda i: F.struct(
        F.concat(F.lit("L"), i).alias("lname"),
        F.concat(F.lit("R"), "o_custkey").alias("role"),
        F.when(i % 2 == 0, F.struct(F.concat(F.lit("P"), i).alias("lname"), F.concat(F.lit("Q"), "o_custkey").alias("role"))).alias("proxy"),
    )
    people = F.transform(F.sequence(F.lit(1), F.lit(3)), person)
    return t.orders.select("o_orderkey", F.explode(bills.numbered_people(people)).alias("p")).select("o_orderkey", "p.*")


@query(
    "split_rows",
    sql="""with s as (select o_orderkey, unnest(string_split('B' || o_custkey || '; B' || (o_custkey + 1) || ' ;B' || (o_custkey * 2), ';')) as bill from orders)
select o_orderkey, trim(bill) as bill, c_name from s left join customer on 'B' || c_custkey = trim(bill)""",
)
def split_rows(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    field = F.concat(F.lit("B"), c, F.lit("; B"), c + 1, F.lit(" ;B"), c * 2)
    rows = bills.split_rows(t.orders.select("o_orderkey", field.alias("bill")), "bill")
    return rows.join(t.customer.select(F.concat(F.lit("B"), "c_custkey").alias("bill"), "c_name"), "bill", "left")


# ---- citations and ids ---------------------------------------------------------------------

@query(
    "bill_citations",
    sql=f"""with s as (select o_orderkey, case o_orderkey % 4 when 0 then 'H.R. ' when 1 then 'S. ' when 2 then 'H.J.Res. ' else 'S.Con.Res. ' end as label, o_custkey from orders)
select o_orderkey, label || o_orderkey || '; H.Res. ' || o_custkey as shown, 2::bigint as n from s""",
)
def bill_citations(t: Tables) -> DataFrame:
    label = F.when(key() % 4 == 0, "hr ").when(key() % 4 == 1, "S. ").when(key() % 4 == 2, "H.J.RES. ").otherwise("S.Con.Res. ")
    title = F.concat(F.lit("Hearing on "), label, key(), F.lit(" and H. Res. ").substr(1, 5), F.lit("H.Res. "), "o_custkey", F.lit(", of 1999"))
    found = F.array_distinct(b.citations(title, F.lit(105)))
    return t.orders.select(
        "o_orderkey",
        F.array_join(F.transform(found, lambda x: b.bill_label(x["bill_type"], x["bill_number"])), "; ").alias("shown"),
        F.size(found).cast("bigint").alias("n"),
    )


@query(
    "bill_urls",
    sql="select o_orderkey, case when o_orderkey % 3 > 0 then (105 + o_orderkey % 10)::int end as congress, case when o_orderkey % 3 > 0 then 'hr' end as bill_type, case when o_orderkey % 3 > 0 then o_custkey::int end as bill_number from orders",
)
def bill_urls(t: Tables) -> DataFrame:
    url = F.when(
        key() % 3 > 0, F.concat(F.lit("https://api.example.org/v3/bill/"), 105 + key() % 10, F.lit("/HR/"), "o_custkey", F.lit("?x=1"))
    ).otherwise("https://api.example.org/none")
    return t.orders.select("o_orderkey", b.bill_from_url(url).alias("x")).select("o_orderkey", "x.*")


@query(
    "json_paths",
    sql="""select o_orderkey, 'hr:' || o_orderkey || '|s:' || o_custkey || case when o_orderkey % 2 = 0 then '|hres:7' else '' end as bills from orders""",
)
def json_paths(t: Tables) -> DataFrame:
    """Meeting JSON whose bill list is an array or one object, with a title citation and a URL."""
    js = F.when(
        key() % 2 == 0,
        F.format_string(
            '{"title": "On H.R. %d", "relatedItems": {"bills": {"bill": [{"url": "https://x/v3/bill/105/s/%d"}, {"type": "HRES", "number": "7", "congress": "105"}]}}}',
            key(), F.col("o_custkey"),
        ),
    ).otherwise(
        F.format_string(
            '{"title": "On H.R. %d", "related_items": {"bills": {"item": {"billType": "S", "billNumber": " %d "}}, "items": {"name": "H.R. %d again"}}}',
            key(), F.col("o_custkey"), key(),
        )
    )
    found = b.related_bills(js, F.lit(105))
    shown = F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["bill_type"], x["bill_number"])), "|")
    return t.orders.select("o_orderkey", shown.alias("bills"))


@query(
    "chamber_infer",
    sql="""select o_orderkey, case o_orderkey % 3 when 0 then 'House' when 1 then 'Senate' else 'Unknown' end as by_id, case o_orderkey % 4 when 0 then 'House' when 1 then 'Senate' when 2 then 'Joint' else 'Other' end as by_text,
 case o_orderkey % 3 when 0 then 'house' when 1 then 'senate' else 'joint' end as by_package, (105 + o_orderkey % 10)::int as congress from orders""",
)
def chamber_infer(t: Tables) -> DataFrame:
    hid = F.concat(F.when(key() % 3 == 0, "HHRG").when(key() % 3 == 1, "shrg").otherwise("x"), key(), F.lit("-"), 105 + key() % 10)
    txt = F.when(key() % 4 == 0, "House of Reps").when(key() % 4 == 1, "US SENATE").when(key() % 4 == 2, "House and Senate, Joint").otherwise("none")
    pid = F.concat(F.lit("CHRG-"), key(), F.when(key() % 3 == 0, "hhrg").when(key() % 3 == 1, "SHRG").otherwise("jhrg"), F.lit("1"))
    return t.orders.select(
        "o_orderkey", b.id_chamber(hid).alias("by_id"), b.named_chamber(txt).alias("by_text"), dates.package_chamber(pid).alias("by_package"), b.id_congress(hid).alias("congress")
    )


@query(
    "page_counts",
    sql="""select o_orderkey, (case o_orderkey % 3 when 0 then 4 when 1 then 19 else 0 end + o_custkey + 11)::int as pages from orders""",
)
def page_counts(t: Tables) -> DataFrame:
    front = F.when(key() % 3 == 0, "iv+").when(key() % 3 == 1, "xix+").otherwise("")
    text = F.concat(front, "o_custkey", F.lit(" p., 10-20"))
    return t.orders.select("o_orderkey", b.page_count(text).alias("pages"))


@query(
    "role_split",
    sql="select o_orderkey, case when o_orderkey % 2 = 0 then 'Director' end as role, case when o_orderkey % 2 = 0 then 'Agency of ' || o_custkey else 'Bureau ' || o_custkey end as affiliation from orders",
)
def role_split(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    text = F.when(key() % 2 == 0, F.concat(F.lit("Director, Agency of "), c, F.lit(", p. 12"))).otherwise(F.concat(F.lit("Bureau "), c, F.lit(" p. 3")))
    return t.orders.select("o_orderkey", b.role_and_affiliation(text).alias("x")).select("o_orderkey", "x.*")


@query(
    "committee_split",
    sql="select o_orderkey, 'Committee on B' || o_custkey || '. House' as committee, case when o_orderkey % 2 = 0 then 'Subcommittee on A' || o_orderkey || ',' end as subcommittee from orders",
)
def committee_split(t: Tables) -> DataFrame:
    tail = F.concat(F.lit("Committee on B"), "o_custkey", F.lit(". House"))
    src = F.when(key() % 2 == 0, F.concat(F.lit("Subcommittee on A"), key(), F.lit(", "), tail)).otherwise(tail)
    return t.orders.select("o_orderkey", b.committee_and_sub(src).alias("x")).select("o_orderkey", "x.*")


@query(
    "html_rows",
    sql="""with r as (select page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) as rows from pages)
select page_id, unnest(range(len(rows)))::bigint as row_no, md5(unnest(rows)) as digest from r""",
)
def html_rows(t: Tables) -> DataFrame:
    r = bills.html_rows(t.pages, "page_id", tag="li")
    return r.select("page_id", "row_no", F.md5("_row").alias("digest"))


@query(
    "html_events",
    sql="""select page_id::int as event_id, page_id, '2001-02-03' as date, 'On S. ' || page_id as title, 'Rules' as committee, 1 as has_bill, 'H.R. 5; S. ' || page_id as bill_numbers from pages""",
)
def html_events(t: Tables) -> DataFrame:
    """Event tables wrapped around each stored page's own markup."""
    row = F.concat(
        F.lit("<tr><td>Event "), "page_id", F.lit("</td><td>2001-02-03</td><td>On <b>S.</b> "), "page_id",
        F.lit('</td><td>Rules</td><td><a href="https://x/bill/105/hr/5">link</a></td></tr>'),
    )
    p = t.pages.select("page_id", F.concat("html", row).alias("html"))
    return bills.hearing_events(p, "page_id", 105)


@query(
    "control_table",
    sql="""with c as (select (104 + r_regionkey)::int as n, (-1) * (r_regionkey * 10 - 15)::int as d from region), x as (select *, abs(d) as m from c), w as (select min(m) lo, max(m) hi from x)
select n as congress_number, (1787 + 2 * n)::int as start_year, (1789 + 2 * n)::int as end_year, case when n % 2 = 0 then 'D' else 'R' end as majority_party, m as seat_margin, round((m - lo) / (hi - lo)::double * 0.4::double + 0.1::double, 6) as power_gap_scaled from x, w""",
)
def control_table(t: Tables) -> DataFrame:
    n = (104 + F.col("r_regionkey")).cast("int")
    raw = t.region.select(
        F.concat(n, F.lit("th")).alias("congress"),
        F.concat((1787 + 2 * n), F.lit(" to "), (1789 + 2 * n)).alias("years"),
        F.when(n % 2 == 0, "Dem").otherwise("Rep").alias("maj_party"),
        (-1 * (F.col("r_regionkey") * 10 - 15)).cast("int").alias("seat_diff"),
    )
    return bills.control_table(raw).withColumn("power_gap_scaled", F.round("power_gap_scaled", 6))


# ---- labels, replies, small text -------------------------------------------------------------

CATS = ["Causal", "Descriptive", "Monetary", "Statistical"]


@query(
    "one_hot",
    sql="select o_orderkey, (o_orderkey % 2 = 0)::int as is_causal, 0 as is_descriptive, 1 as is_monetary, (o_orderkey % 3 = 0)::int as is_statistical, (o_orderkey % 2 = 0)::int as ra_causal, 1 as ra_monetary from orders",
)
def one_hot(t: Tables) -> DataFrame:
    stars = F.concat(F.when(key() % 2 == 0, "Causal ***** ").otherwise(""), F.lit(" Monetary."), F.when(key() % 3 == 0, " ***** 1. Statistical").otherwise(""))
    commas = F.concat(F.when(key() % 2 == 0, "Causal, ").otherwise(""), F.lit("Mone tary."))
    return t.orders.select("o_orderkey", *b.one_hot(b.star_labels(stars), CATS), *b.one_hot(b.comma_labels(commas), ["causal", "monetary"], "ra_"))


@query("array_distinct", sql="select o_orderkey, case when o_custkey = o_orderkey then o_custkey || '; x' else o_custkey || '; x; ' || o_orderkey end as joined from orders")
def array_distinct(t: Tables) -> DataFrame:
    arr = F.array(F.col("o_custkey").cast("string"), F.lit("x"), key().cast("string"), F.col("o_custkey").cast("string"), F.lit("x"))
    return t.orders.select("o_orderkey", F.array_join(F.array_distinct(arr), "; ").alias("joined"))


@query("set_equal", sql="select o_orderkey, (o_orderkey % 3 > 0)::int as agree from orders")
def set_equal(t: Tables) -> DataFrame:
    other = F.when(key() % 3 == 0, "b").when(key() % 3 == 1, "B , a").otherwise("a,b,A")
    return t.orders.select("o_orderkey", b.same_set(F.lit("a, b"), other).alias("agree"))


@query(
    "reply_parse",
    sql="select conv_id, turn, (turn % 2 = 0)::int as is_empirical, 2::bigint as n_quotes, md5(trim(text, E' \\n\\t\\r')) as quote_digest, 'Causal|Monetary' as categories from conversations",
)
def reply_parse(t: Tables) -> DataFrame:
    first, second, third = b.SECTIONS
    reply = F.concat(
        F.lit(first + "\n"), F.when(F.col("turn") % 2 == 0, " Yes").otherwise("no"), F.lit(f"\n{second}\n"), "text", F.lit(" ***** second one\n"), F.lit(third + "\nCausal ***** Monetary\n")
    )
    p = t.conversations.select("conv_id", "turn", b.reply_sections(reply).alias("r"))
    return p.select(
        "conv_id", "turn", b.yes_no(F.col("r.binary")).alias("is_empirical"), F.size("r.quotes").cast("bigint").alias("n_quotes"),
        F.md5(F.regexp_replace(F.get("r.quotes", F.lit(0)), r"^\s+|\s+$", "")).alias("quote_digest"), F.array_join("r.categories", "|").alias("categories"),
    )


@query("prob_parse", sql="select event_id, case when event_id % 7 > 0 then round(value / 1000, 6) end as p from events")
def prob_parse(t: Tables) -> DataFrame:
    p = F.round(F.col("value") / 1000, 6)
    text = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("[0.5  "), p.cast("string"), F.lit(" ]"))).otherwise("[bad]")
    return t.events.select("event_id", b.positive_probability(text).alias("p"))


@query("prompt_text", sql="select conv_id, turn, md5('<context_before>  </context_before> <target_sentence> ' || text || ' </target_sentence> <context_after> x </context_after>') as digest from conversations")
def prompt_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.md5(b.prompt(F.lit(""), F.col("text"), F.lit("x"))).alias("digest"))


@query("zero_pad", sql="select c_custkey, case when c_custkey % 5 = 0 then null else lpad(c_custkey::varchar, 5, '0') end as thomas from customer")
def zero_pad(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.select("c_custkey", names.zero_padded(F.when(c % 5 == 0, "n/a").otherwise(F.concat(c.cast("string"), F.lit(".0")))).alias("thomas"))


@query("title_cases", sql="select p_partkey, upper(p_name[1]) || case when contains(p_name, ' ') then substr(split_part(p_name, ' ', 1), 2) || ' of ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) else substr(p_name, 2) end as name, upper(p_type[1]) || lower(substr(p_type, 2)) as kind from part")
def title_cases(t: Tables) -> DataFrame:
    name = F.upper(F.concat(F.lit("HOUSE COMMITTEE ON "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" of "))))
    return t.part.select(
        "p_partkey", names.title_case(names.without_prefix(name, "HOUSE COMMITTEE ON ")).alias("name"), names.capitalized(F.col("p_type")).alias("kind")
    )


@query("normalized_titles", sql="select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) as digest from documents")
def normalized_titles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(names.simple_title(F.col("text"))).alias("digest"))


# ---- dates -------------------------------------------------------------------------------------


@query(
    "month_slices",
    sql="""with y as (select distinct year(o_orderdate)::int as y from orders) select y as year, d::date::varchar as start_day, last_day(d::date)::varchar as end_day from y, lateral (select unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 1), interval 1 month)) as d)""",
)
def month_slices(t: Tables) -> DataFrame:
    y = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    s = y.select("year", F.explode(dates.month_starts(F.col("year"))).alias("d"))
    return s.select("year", F.col("d").cast("string").alias("start_day"), F.last_day("d").cast("string").alias("end_day"))


@query("quarter_slices", sql="with y as (select distinct year(o_orderdate)::int as y from orders) select y as year, d::date::varchar as start_day, last_day((d + interval 2 month)::date)::varchar as end_day from y, lateral (select unnest(generate_series(make_date(y, 1, 1), make_date(y, 10, 1), interval 3 month)) as d)")
def quarter_slices(t: Tables) -> DataFrame:
    y = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    s = y.select("year", F.explode(dates.quarter_starts(F.col("year"))).alias("d"))
    return s.select("year", F.col("d").cast("string").alias("start_day"), F.last_day(F.add_months("d", 2)).cast("string").alias("end_day"))


@query("year_expand", sql="select o_orderkey, y::int as year from orders, lateral (select unnest(range(year(o_orderdate), year(o_orderdate) + 2)) as y)")
def year_expand(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", F.explode(F.sequence(y, y + 1)).alias("year"))


@query("year_month", sql="select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, strftime(o_orderdate, '%B %d, %Y') as shown, ((year(o_orderdate) - 1788) // 2 + 1)::int as congress, (o_orderkey % 9 > 0)::int as parsed from orders")
def year_month(t: Tables) -> DataFrame:
    text = F.col("o_orderdate").cast("date").cast("string")
    messy = F.when(key() % 9 > 0, text).otherwise("no date")
    return t.orders.select(
        "o_orderkey", dates.year_of(text).alias("y"), dates.month_of(text).alias("m"), F.date_format("o_orderdate", "MMMM dd, yyyy").alias("shown"),
        dates.election_congress(F.year("o_orderdate")).alias("congress"), dates.parse_date(messy).isNotNull().cast("int").alias("parsed"),
    )
