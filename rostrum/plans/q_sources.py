"""Round trips through the sources, sinks, stage tables and streams."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import dictionaries
from ..operators import relational as rel
from ..session import checkpoint_dir
from ..sources import readers, stage, writers
from ..streaming import ingest
from .catalog import Tables, query
from .q_labels import vowel_share


def scratch(t: Tables, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("roundtrip_csv", sql="select c_custkey, c_name, c_acctbal, c_mktsegment, null::varchar as gender from customer")
def roundtrip_csv(t: Tables) -> DataFrame:
    """CSV out and in again with an explicit schema and one column that is absent."""
    path = scratch(t, "csv")
    writers.to_csv(t.customer, path)
    schema = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string, gender string"
    return readers.csv(t.spark, path, schema)


@query("roundtrip_parquet", sql="select o_orderkey, o_custkey, o_orderpriority from orders where o_orderpriority = '2-HIGH'")
def roundtrip_parquet(t: Tables) -> DataFrame:
    """Partitioned Parquet; the filter prunes partitions."""
    path = scratch(t, "parquet")
    writers.to_parquet(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), path, ["o_orderpriority"])
    return t.spark.read.parquet(path).filter(F.col("o_orderpriority") == "2-HIGH")


@query("roundtrip_json", sql="select event_id, user_id, event_type, value, (props->>'$.k')::bigint as k from events")
def roundtrip_json(t: Tables) -> DataFrame:
    path = scratch(t, "json")
    writers.to_json(t.events.select("event_id", "user_id", "event_type", "value", "props"), path)
    df = t.spark.read.schema("event_id bigint, user_id bigint, event_type string, value double, props string").json(path)
    return df.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("training_messages", sql="select conv_id, turn, md5(text) as user_digest, role as answer from conversations")
def training_messages(t: Tables) -> DataFrame:
    path = scratch(t, "messages")
    src = t.conversations.withColumn("user", F.to_json(F.struct("conv_id", "turn", "text")))
    writers.to_messages(src, path, "Label the sentence.", "user", "role")
    got = t.spark.read.schema("messages array<struct<role:string,content:string>>").json(path)
    u = F.from_json(F.col("messages")[1]["content"], "conv_id bigint, turn bigint, text string")
    return got.select(u.alias("u"), F.col("messages")[2]["content"].alias("answer")).select(
        "u.conv_id", "u.turn", F.md5("u.text").alias("user_digest"), "answer"
    )


@query("narrow_types", sql="select o_orderkey, (o_custkey % 120)::smallint::int as congress, (o_orderkey % 2)::int as minority, case when o_orderkey % 3 > 0 then o_orderdate::date::varchar end as d, o_orderpriority as text from orders")
def narrow_types(t: Tables) -> DataFrame:
    """CSV to narrow Parquet: renamed text, small integers, tolerant dates."""
    src, out = scratch(t, "wide"), scratch(t, "narrow")
    k = F.col("o_orderkey")
    writers.to_csv(
        t.orders.select(
            "o_orderkey", (F.col("o_custkey") % 120).alias("congress"), (k % 2).alias("minority"),
            F.when(k % 3 > 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("n/a").alias("hearing_date"), F.col("o_orderpriority").alias("target_sentence"),
        ),
        src,
    )
    writers.csv_to_parquet(t.spark, src, out)
    df = t.spark.read.parquet(out)
    return df.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("congress").cast("int").alias("congress"), F.col("minority").cast("int").alias("minority"),
        F.col("hearing_date").cast("date").cast("string").alias("d"), "text",
    )


@query("point_lookup", sql="select conv_id, turn, md5(text) as digest from conversations where conv_id = 7 and turn = 2")
def point_lookup(t: Tables) -> DataFrame:
    p = readers.point(t.conversations, ["conv_id", "turn", "text", "absent"], conv_id=7, turn=2)
    return p.select("conv_id", "turn", F.md5("text").alias("digest"))


@query("light_scan", sql="select doc_id, lang, source, n_chars from documents")
def light_scan(t: Tables) -> DataFrame:
    """The table without its heavy column; the scan does not read it."""
    return readers.without_heavy(t.documents, ("text",))


@query("stage_cache", sql="select o_custkey, count(*)::bigint as n from orders group by 1")
def stage_cache(t: Tables) -> DataFrame:
    """A stage built once and read on the second use."""
    path = scratch(t, "stage")
    build = lambda: t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    stage.cached(t.spark, path, build, newer_than=t.path("orders"))

    def never():
        raise AssertionError("the stage was built twice")

    return stage.cached(t.spark, path, never, newer_than=t.path("orders"))


@query("multi_file", sql="select l_returnflag as folder, count(*)::bigint as n, round(sum(l_quantity), 2) as quantity from lineitem group by 1")
def multi_file(t: Tables) -> DataFrame:
    """Many CSV files read as one, the source kept per row."""
    path = scratch(t, "many")
    t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag").write.partitionBy("l_returnflag").option("header", True).csv(path)
    df = readers.csv_union(t.spark, f"{path}/*/*.csv", "l_orderkey bigint, l_quantity double")
    folder = F.regexp_extract(F.col("file_path"), "l_returnflag=([A-Z]+)", 1)
    return df.withColumn("folder", folder).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("tolerant_scan", sql="select c_custkey::varchar as id, c_name as name from customer where c_custkey % 10 > 0")
def tolerant_scan(t: Tables) -> DataFrame:
    """CSV with broken lines: every tenth row has two fields too many."""
    path = scratch(t, "bad")
    k = F.col("c_custkey")
    lines = t.customer.select(F.concat(k.cast("string"), F.lit(","), "c_name", F.when(k % 10 == 0, ",x,y").otherwise("")).alias("value"))
    writer = t.spark.createDataFrame([("id,name",)], "value string").unionByName(lines)
    # One header line opens every part file here, so the parts are read with a fixed schema.
    writer.write.text(path)
    schema = "id string, name string"
    reader = t.spark.read.schema(schema).option("mode", "DROPMALFORMED").option("columnPruning", False)
    return reader.csv(path).filter(F.col("id") != "id")


@query("slice_combine", sql="select o_orderkey, o_custkey::bigint as v from orders")
def slice_combine(t: Tables) -> DataFrame:
    """Overlapping slices with columns in another order, and an empty file: the last slice wins per key."""
    path = scratch(t, "slices")
    v = F.col("o_custkey")
    t.orders.select("o_orderkey", (v + 1).alias("v")).write.option("header", True).csv(f"{path}/slice0")
    t.orders.select(v.alias("v"), F.lit("x").alias("more"), "o_orderkey").write.option("header", True).csv(f"{path}/slice1")
    t.orders.limit(0).select("o_orderkey", v.alias("v")).write.csv(f"{path}/slice2")
    return readers.slices(t.spark, f"{path}/slice*", "o_orderkey bigint, v bigint", ["o_orderkey"])


@query("json_pages", sql="select 'CHRG-' || o_orderkey as \"packageId\", (105 + o_orderkey % 5)::int as congress, o_orderpriority as title from orders")
def json_pages(t: Tables) -> DataFrame:
    """Landed package pages: nested, with defaults, each id twice."""
    path = scratch(t, "pages")
    p = F.struct(
        F.concat(F.lit("CHRG-"), "o_orderkey").alias("packageId"), F.col("o_orderpriority").alias("title"),
        (105 + F.col("o_orderkey") % 5).cast("string").alias("congress"), F.lit("2001-01-01").alias("lastModified"),
    )
    # A page is one file with a few thousand packages.
    page = F.floor(F.col("o_orderkey") / 4_000).alias("page")
    pages = t.orders.select(page, F.explode(F.array(p, p)).alias("p")).groupBy("page").agg(F.collect_list("p").alias("packages"))
    pages.repartition("page").write.partitionBy("page").json(path)
    return readers.packages(t.spark, path).select("packageId", "congress", "title")


@query("bill_files", sql="select 'hr' || o_orderkey || '-105' as bill_id, 'B' || o_custkey as sponsor_id from orders")
def bill_files(t: Tables) -> DataFrame:
    """Nested bill JSON found recursively under folders."""
    path = scratch(t, "bills")
    doc = t.orders.select(
        F.concat(F.lit("hr"), "o_orderkey", F.lit("-105")).alias("bill_id"),
        F.struct(F.concat(F.lit("B"), "o_custkey").alias("bioguide_id")).alias("sponsor"),
        (F.col("o_orderkey") % 3).alias("folder"),
    )
    doc.write.partitionBy("folder").json(path)
    reader = t.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(schemas.BILLS)
    return reader.json(path).select("bill_id", F.col("sponsor.bioguide_id").alias("sponsor_id"))


@query("bill_documents", sql="select 'hr' || n_nationkey || '-105' as bill_id, n_name as official_title, 'B' || n_regionkey as sponsor_id, 2::bigint as n_actions from nation")
def bill_documents(t: Tables) -> DataFrame:
    """Bill files through the library's reader: one pretty-printed document each, in folders."""
    path = scratch(t, "documents")
    k = F.col("n_nationkey").cast("string")
    action = F.concat(F.lit('{"status": "REPORTED", "acted_at": "2001-01-0'), F.col("n_regionkey") + 1, F.lit('"}'))
    text = F.concat(
        F.lit('{\n "bill_id": "hr'), k, F.lit('-105",\n "official_title": "'), "n_name", F.lit('",\n "actions": ['), action, F.lit(",\n  "), action,
        F.lit('],\n "sponsor": {"bioguide_id": "B'), "n_regionkey", F.lit('"}\n}'),
    )
    t.nation.select("n_nationkey", "n_regionkey", text.alias("value")).write.partitionBy("n_regionkey", "n_nationkey").text(path)
    bills = readers.bills(t.spark, path, "*.txt")
    return bills.select("bill_id", "official_title", F.col("sponsor.bioguide_id").alias("sponsor_id"), F.size("actions").cast("bigint").alias("n_actions"))


@query("hearing_tables", sql="select 'h' || o_orderkey as hearing_id, (105 + o_orderkey % 5)::int as congress, case when o_orderkey % 2 = 0 then 'House' else 'Senate' end as chamber, o_orderstatus || ', \"' || o_orderpriority || '\"' as title from orders")
def hearing_tables(t: Tables) -> DataFrame:
    """A dimension table through the library's reader: columns in another order, quotes and commas."""
    folder = scratch(t, "tables")
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"')).alias("title"), (105 + k % 5).alias("congress"), F.lit("x").alias("unused"),
        F.when(k % 2 == 0, "House").otherwise("Senate").alias("chamber"), F.concat(F.lit("h"), k).alias("hearing_id"),
    )
    writers.to_csv(rows, f"{folder}/hearings.csv")
    return readers.table(t.spark, folder, "hearings")


@query("hearing_text_files", sql="select 'h' || conv_id || '-' || turn as hearing_id, md5(text) as digest from conversations where role = 'user' and text is not null")
def hearing_text_files(t: Tables) -> DataFrame:
    """Quoted multi-line transcripts, the wanted hearings only."""
    path = f"{scratch(t, 'texts')}/texts.csv"
    hearing = F.concat(F.lit("h"), "conv_id", F.lit("-"), "turn").alias("hearing_id")
    writers.to_csv(t.conversations.select(hearing, F.col("text").alias("raw_text")), path)
    ids = t.conversations.filter("role = 'user' and text is not null").select(hearing)
    return readers.hearing_texts(t.spark, path, ids).select("hearing_id", F.md5("raw_text").alias("digest"))


@query("ideology_rows", sql="select (100 + s_suppkey % 20)::int as congress, 'B' || s_suppkey as bioguide_id, round(s_acctbal / 10000, 6) as nominate_dim1 from supplier where s_suppkey % 3 > 0 and 100 + s_suppkey % 20 between 105 and 114")
def ideology_rows(t: Tables) -> DataFrame:
    """Ideology scores of one chamber and a range of congresses."""
    path = scratch(t, "ideology")
    k = F.col("s_suppkey")
    rows = t.supplier.select(
        F.when(k % 3 > 0, "House").otherwise("Senate").alias("chamber"), (100 + k % 20).alias("congress"), F.concat(F.lit("B"), k).alias("bioguide_id"),
        F.round(F.col("s_acctbal") / 10000, 6).alias("nominate_dim1"),
    )
    writers.to_csv(rows, path)
    return readers.ideology(t.spark, path, (105, 114)).select("congress", "bioguide_id", "nominate_dim1")


@query("election_rows", sql="select (2000 + c_custkey % 10)::int as year, 'S' || c_nationkey as state_po, c_custkey::varchar as district, c_acctbal::double as candidatevotes, (c_acctbal + 1000)::double as totalvotes from customer where c_custkey % 7 > 0")
def election_rows(t: Tables) -> DataFrame:
    """Election results; every seventh line has two fields too many and is dropped."""
    path = scratch(t, "elections")
    k = F.col("c_custkey")
    line = F.concat_ws(",", 2000 + k % 10, F.concat(F.lit("S"), "c_nationkey"), k, "c_acctbal", F.col("c_acctbal") + 1000, F.when(k % 7 == 0, "x,y"))
    head = "year,state_po,district,candidatevotes,totalvotes"

    def with_head(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    # Every file with a header line of its own, as such tables come.
    t.customer.select(line.alias("value")).mapInArrow(with_head, "value string").write.text(path)
    return readers.elections(t.spark, path)


@query("xml_scan", sql="select o_orderkey::varchar as id, o_custkey::varchar as first_person, 2::bigint as n_people from orders")
def xml_scan(t: Tables) -> DataFrame:
    """Hearing XML with repeated participants."""
    path = scratch(t, "xml")
    person = lambda c: F.struct(c.cast("string").alias("lname"))
    doc = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.array(person(F.col("o_custkey")), person(F.col("o_orderkey"))).alias("participant"))
    doc.write.format("xml").option("rowTag", "hearing").option("rootTag", "hearings").save(path)
    schema = "id string, participant array<struct<lname:string>>"
    x = readers.xml(t.spark, path, "hearing", schema)
    return x.select("id", F.col("participant")[0]["lname"].alias("first_person"), F.size("participant").cast("bigint").alias("n_people"))


@query("fulltext_xml", sql="select o_orderkey::varchar as id, o_orderpriority || ' and ' || o_custkey as raw_text from orders")
def fulltext_xml(t: Tables) -> DataFrame:
    path = scratch(t, "fulltext")
    doc = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.array("o_orderpriority", F.concat(F.lit("and "), "o_custkey")).alias("fulltext")
    )
    doc.write.format("xml").option("rowTag", "doc").option("rootTag", "docs").save(path)
    return readers.xml_full_text(t.spark, path, "doc", "id", "fulltext")


@query("dict_load", sql="with x as (select (p_size % 3 + 1)::int as version, lower(replace(p_name, '-', ' ')) as term from part) select version, term, min(upper(term)) as original from x group by 1, 2")
def dict_load(t: Tables) -> DataFrame:
    """Several numbered term lists, normalized and de-duplicated."""
    path = scratch(t, "dicts")
    for v in (1, 2, 3):
        t.part.filter(F.col("p_size") % 3 + 1 == v).select(F.upper("p_name")).write.csv(f"{path}/list_{v}.csv")
    return dictionaries.load_terms(t.spark, f"{path}/list_*.csv")


@query("leader_files", sql="select s_nationkey::int as congress, 'T' || s_suppkey as thomas_id, 'chair' as role, 0 as ord, 'B' || s_suppkey as bioguide_id from supplier union all select s_nationkey::int, 'T' || s_suppkey, 'chair', 1, 'C' || s_suppkey from supplier where s_suppkey % 2 = 0 union all select s_nationkey::int, 'T' || s_suppkey, 'ranking_member', 0, 'R' || s_suppkey from supplier")
def leader_files(t: Tables) -> DataFrame:
    """Leader JSON whose fields hold one id or a list."""
    path = scratch(t, "leaders")
    k = F.col("s_suppkey").cast("string")
    two = F.concat(F.lit('["B'), k, F.lit('","C'), k, F.lit('"]'))
    one = F.concat(F.lit('"B'), k, F.lit('"'))
    line = F.concat(
        F.lit('{"congress":'), "s_nationkey", F.lit(',"thomas_id":"T'), k, F.lit('","chair":'), F.when(F.col("s_suppkey") % 2 == 0, two).otherwise(one),
        F.lit(',"ranking_member":"R'), k, F.lit('"}'),
    )
    t.supplier.select(line.alias("value")).write.text(path)
    return readers.leaders(t.spark, path)


# ---- streams -------------------------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _land(t: Tables, name: str, copies: int = 2) -> str:
    """Events delivered several times over."""
    path = scratch(t, name)
    for _ in range(copies):
        t.events.write.mode("append").parquet(path)
    return path


@query("stream_dedupe", sql="select event_id, user_id, event_type, strftime(ts, '%Y-%m') as month from events")
def stream_dedupe(t: Tables) -> DataFrame:
    landed, out, ck = _land(t, "landed"), scratch(t, "fresh"), scratch(t, "ck")
    ingest.append_new(t.spark, landed, EVENTS, out, ck, key=["event_id"], time_col="ts", files_per_batch=1)
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type", "month")


@query("stream_latest", sql="select user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def stream_latest(t: Tables) -> DataFrame:
    landed, out, ck = _land(t, "updates"), scratch(t, "log"), scratch(t, "ck")
    ingest.upsert_log(t.spark, landed, EVENTS, out, ck, key=["user_id"], modified="ts", files_per_batch=1)
    return ingest.latest(t.spark, out).select("user_id", "event_id")


@query("stream_score", sql="select conv_id, turn, ((length(text) - length(regexp_replace(text, '[aeiou]', '', 'g'))) / greatest(length(text), 1)::double > 0.5)::int as label from conversations")
def stream_score(t: Tables) -> DataFrame:
    landed, out, ck = scratch(t, "texts"), scratch(t, "scores"), scratch(t, "ck")
    t.conversations.write.parquet(landed)
    schema = "conv_id bigint, turn bigint, role string, text string"
    ingest.score(t.spark, landed, schema, out, ck, text_col="text", scorer=vowel_share)
    return t.spark.read.parquet(out).select("conv_id", "turn", "label")
