"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, packing, passages, prefixes, quality, ranked, secrets, simhash, toxicity, urls, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@_query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP2_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{_W}') as words,
         string_split(coalesce(text, ''), chr(10)) as lines
  from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from d),
win as (
  select doc_id, i, string_agg(word, ' ') over o as win, count(*) over o as k
  from w window o as (partition by doc_id order by i rows between current row and {quality.WINDOW - 1} following)),
rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from win where k = {quality.WINDOW}) where c > 1),
cov as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {quality.WINDOW})) as p from rep) group by doc_id),
l as (select doc_id, unnest(lines) as line from d),
j as (
  select doc_id, line, len(regexp_extract_all(line, '{_W}')) as n,
         len(regexp_extract_all(line, {_lit(quality.PILED_MARKS)})) as piled,
         len(regexp_extract_all(line, {_lit(quality.SEPARATOR)})) as parted,
         {" or ".join(f"contains(lower(line), {_lit(p)})" for p in quality.NOTICES)} as notice
  from l),
s as (
  select doc_id, sum(length(line)) as line_chars,
         coalesce(sum(length(line)) filter (where (piled > 0 and piled * {quality.WORDS_PER_PILE} >= n)
           or (parted > 0 and parted * {quality.WORDS_PER_SEPARATOR} >= n) or (length(line) <= {quality.NOTICE_LINE} and notice)), 0) as lost,
         count(*) filter (where n > 0) as with_word, count(distinct line) filter (where n > 0) as different
  from j group by doc_id),
m as (
  select d.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         (with_word - different)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, lost, line_chars
  from d join s using (doc_id) left join cov using (doc_id)),
b as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * lost <= {quality.MAX_LOST_PERCENT} * line_chars as kept
from b
"""


@_query("op2_quality", OP2_SQL)
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of the line-first quality rules for every document."""
    done = quality.assess(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: counts per base kind and the spans spelled out."""
    done = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return done.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spelled(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


#: Host, path prefix and verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

OP4_SQL = """
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u),
r(h, p, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select page_id, h || p as rule, verdict,
         row_number() over (partition by page_id order by len(string_split(h, '.')) desc, length(p) desc) as n
  from (select p.page_id, p.host, p.path as path, r.h, r.p, r.verdict from p, r)
  where (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from p left join m on p.page_id = m.page_id and m.n = 1
"""


@_query("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and deciding rule for the url of every page."""
    done = urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return done.select("page_id", "host", "path", "rule", "verdict")


@_query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all document pieces in sequences of 2,048 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


OP3_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, max(page_id) as top from p group by 1)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from p join m using (payload_digest)
"""


@_query("op3_warc", OP3_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived as a WARC record and read back."""
    done = warc.archived(_read(spark, sf_dir, "pages"))
    return done.select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


_PROBE = "</s>[INST] ok [/INST]"


def _escape_sql(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP9_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum({len(chat.OPEN) + len(chat.CLOSE) + 1} + length(replace({_escape_sql("role")}, chr(10), '\\n')) + length({_escape_sql("text")}))::bigint as formatted_chars
from c group by conv_id
"""


@_query("op9_chat_format", OP9_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what the formatted output says."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(_PROBE))
    return chat.digests(chat.format_chats(rows.union(probe)))


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model of the labelled ones."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.assess(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


@_query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds a passage."""
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op7_langid")
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    prototypes = langid.train(docs.filter(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    done = langid.identify(docs, prototypes)
    return done.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') as words
  from documents),
s as (select count(*) as n_docs, sum(len(words))::bigint as total from d where len(words) > 0),
p as (
  select doc_id, word, n, count(*)::bigint as tf
  from (select doc_id, len(words) as n, unnest(words) as word from d) group by all),
f as (select word, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from (select word, count(*) as df from p group by word), s),
i as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) as word
  from benchmark),
x as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::bigint as score
  from i join p using (word) join f using (word), s group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from x where score > 0 qualify rank <= 10
"""


@_query("op11_nra_search", OP11_SQL)
def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that answer each benchmark item best."""
    return ranked.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: crc32 of an ASCII string, as the table-free division by the reversed polynomial.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::ubigint, [ascii(x)::ubigint for x in string_split({0}, '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint for _ in range(8)]), lambda c, z: xor(c >> 1, 3988292384::ubigint * (c & 1)))))"""

OP12_SQL = f"""
with c as (
  select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own,
         ({_CRC32.format("conv_id::varchar")} % {prefixes.HEADS})::int as h
  from conversations where conv_id is not null group by conv_id),
r as (
  select c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) as turns
  from c left join c b on b.conv_id = c.conv_id - c.conv_id % {prefixes.HUNDRED}),
m as (select conv_id, turns, d, d = len(turns) as ends, turns[1:d] as said from (select *, unnest(range(0, len(turns) + 1)) as d from r)),
n as (
  select d, said, min(conv_id) as top, count(*) as n_convs, case when d > 0 then length(said[d].text) else 0 end as chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from m group by d, said),
k as (select n.*, p.top as parent, (select count(*) from n ch where ch.d = n.d + 1 and ch.said[1:n.d] = n.said) as n_children
      from n left join n p on p.d = n.d - 1 and p.said = n.said[1:n.d - 1]),
s as (
  select a.top, a.d, sum((u.n_children = 0)::int)::bigint as n_leaves, sum((u.n_convs - 1) * u.chars)::bigint as saved
  from k u join k a on a.d <= u.d and a.said = u.said[1:a.d] group by a.top, a.d)
select k.top as conv_id, k.d as depth, k.parent as parent_conv_id, n_convs, n_children, n_leaves, saved as saved_tokens, ends_sha256
from k join s on s.top = k.top and s.d = k.d
"""


@_query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefixes.prefix_trie(_read(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') as words from documents),
w as (select doc_id, unnest(range(1, len(words) - {passages.WINDOW - 2})) as i, words from d where len(words) >= {passages.WINDOW}),
h as (select doc_id, i, array_to_string(words[i:i + {passages.WINDOW - 1}], ' ') as win from w),
f as (select win, min(doc_id) as lo from h group by win),
r as (select doc_id, list(i) as starts from (select doc_id, i from h join f using (win) where doc_id > lo) group by doc_id),
c as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(s, s + {passages.WINDOW})) as p from (select doc_id, unnest(starts) as s from r)) group by doc_id),
e as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p, gone from d left join c using (doc_id)),
k as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from e where gone is null or not list_contains(gone, p) group by doc_id)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""


@_query("op13_passages", OP13_SQL)
def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document of a smaller id has as well."""
    return passages.remove_repeats(_read(spark, sf_dir, "documents"))
