"""Transcript, sentence, keyword and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ordered, stats, transcripts
from .catalog import Tables, query
from .fixtures import DOC_SENTENCES_SQL, SENTENCES_SQL, TRANSCRIPTS_SQL, word_sql
from .fixtures import transcripts as transcript_rows

EVIDENCE = ["the", "and", "eine", "un", "%"]


@query(
    "segment_speakers",
    sql=f"with {TRANSCRIPTS_SQL} select conv_id, turn, chunk_pos, speaker, text from chunks where text is not null",
)
def segment_speakers(t: Tables) -> DataFrame:
    return transcripts.segment(transcript_rows(t))


@query(
    "carry_speaker",
    sql="""
with raw as (
  select conv_id, turn, role, unnest(string_split(text, chr(10))) as body,
         unnest(range(len(string_split(text, chr(10))))) as ln from conversations),
lines as (
  select conv_id, turn * 1048576 + ln as pos,
         case when ln = 0 and role = 'user' then '    Mr. Smith. ' when ln = 0 and role = 'system' then '    The Chairman. ' else '' end || body as line,
         case when ln = 0 and role = 'user' then 'Mr. Smith' when ln = 0 and role = 'system' then 'The Chairman' end as mark,
         trim(body) as said
  from raw),
kept as (select * from lines where not contains(line, '....') and regexp_matches(line, '\\S')),
run as (select *, sum((mark is not null)::int) over (partition by conv_id order by pos) as g from kept)
select conv_id, pos::bigint as pos, g::bigint as chunk_id, max(mark) over (partition by conv_id, g) as speaker, said
from run where g > 0 and said <> ''
""",
)
def carry_speaker(t: Tables) -> DataFrame:
    """Assistant turns carry no header here, so they belong to whoever spoke before."""
    head = F.when(F.col("role") == "user", "    Mr. Smith. ").when(F.col("role") == "system", "    The Chairman. ")
    lines = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("ln", "body"))
    lines = lines.select(
        "conv_id",
        F.struct("turn", "ln").alias("at"),
        F.concat(F.when(F.col("ln") == 0, F.coalesce(head, F.lit(""))).otherwise(""), "body").alias("line"),
    )
    block = F.struct("at.turn", F.floor(F.col("at.ln") / 1048576).alias("part"))
    out = transcripts.carry_speaker(lines, ["conv_id"], "at", "line", block=block)
    return out.select("conv_id", (F.col("at.turn") * 1048576 + F.col("at.ln")).alias("pos"), "chunk_id", "speaker", "said")


@query(
    "sentence_records",
    sql=f"""with {SENTENCES_SQL}
select conv_id, turn, chunk_pos, speaker, sent_pos, context_before, sentence, context_after,
       case speaker when 'Mr. Smith' then 'SMITH' when 'Ms. Van Orden' then 'VAN ORDEN' else 'CHAIRMAN' end as speaker_last_name,
       case speaker when 'Mr. Smith' then 'SMITH' when 'Ms. Van Orden' then 'ORDEN' else 'CHAIRMAN' end as speaker_last_word
from sents""",
)
def sentence_records(t: Tables) -> DataFrame:
    return transcripts.sentence_records(transcript_rows(t))


def number_sentences(sentences: DataFrame) -> DataFrame:
    """sentence_id by (turn, chunk_pos, sent_pos) within conv_id, in blocks of a turn's speeches."""
    s = sentences.withColumn("pos", F.struct("turn", "chunk_pos", "sent_pos"))
    block = F.struct("turn", F.floor(F.col("chunk_pos") / 65536).alias("part"))
    return ordered.with_ordered(s, ["conv_id"], "pos", block=block, number="sentence_id").drop("pos")


@query(
    "sentence_numbers",
    sql=f"""with {SENTENCES_SQL}
select conv_id, turn, sent_pos,
       row_number() over (partition by conv_id order by turn, chunk_pos, sent_pos) as sentence_id from sents""",
)
def sentence_numbers(t: Tables) -> DataFrame:
    """Running sentence number per hearing, however long the hearing is."""
    return number_sentences(transcripts.sentence_records(transcript_rows(t))).select("conv_id", "turn", "sent_pos", "sentence_id")


@query(
    "document_sentences",
    sql=f"with {DOC_SENTENCES_SQL} select doc_id, sent_pos::bigint as sent_pos, md5(sentence) as digest from dsents",
)
def document_sentences(t: Tables) -> DataFrame:
    """One row per document to one row per sentence, columns kept."""
    s = transcripts.to_sentences(t.documents.select("doc_id", "text"))
    return s.select("doc_id", "sent_pos", F.md5("sentence").alias("digest"))


@query(
    "silent_hearings",
    sql=f"""with {SENTENCES_SQL}
select conv_id, turn from conversations
where (conv_id, turn) not in (select (conv_id, turn) from sents where speaker <> 'The Chairman')""",
)
def silent_hearings(t: Tables) -> DataFrame:
    """Transcripts that gave no sentence: system turns lose their header indent here."""
    indent = F.regexp_replace("raw_text", "^    The", "The")
    rows = transcript_rows(t).withColumn("raw_text", indent).withColumn("tid", F.struct("conv_id", "turn"))
    rec = transcripts.sentence_records(rows)
    return transcripts.without_sentences(rows, rec, "tid").select("conv_id", "turn")


@query(
    "inline_speakers",
    sql="""
with src as (
  select conv_id, turn, 'Opening words. Mr SMITH ' || replace(text, chr(10), ' ') || ' CHAIRMAN thanks. Ms DOE yields.' as t from conversations),
cut as (select conv_id, turn, string_split(regexp_replace(t, '((?:Mr|Ms|Senator)\\s+[A-Z][A-Z]+|CHAIRMAN|CHAIRWOMAN)', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as p from src),
flat as (select conv_id, turn, unnest(p) as x, unnest(range(len(p))) as i from cut)
select conv_id, turn, (i + 1)::bigint as para_num,
       case when contains(x, chr(2)) then split_part(x, chr(2), 1) else 'Unknown' end as speaker,
       trim(case when contains(x, chr(2)) then split_part(x, chr(2), 2) else x end) as text
from flat""",
)
def inline_speakers(t: Tables) -> DataFrame:
    src = t.conversations.select(
        "conv_id",
        "turn",
        F.concat(
            F.lit("Opening words. Mr SMITH "),
            F.translate("text", "\n", " "),
            F.lit(" CHAIRMAN thanks. Ms DOE yields."),
        ).alias("raw_text"),
    )
    return transcripts.segment_inline(src)


RATE_SQL = """
select {g}, mean, cnt as count, round(sqrt(greatest(mean * (1 - mean) / cnt, 0)), 6) as se,
       round(1.96::double * sqrt(greatest(mean * (1 - mean) / cnt, 0)), 6) as ci_95, round(mean * 100, 6) as mean_pct,
       round(196::double * sqrt(greatest(mean * (1 - mean) / cnt, 0)), 6) as ci_95_pct
from (select {g}, avg(hit) as mean, count(hit) as cnt from hits group by {g})
"""


def _rounded(df: DataFrame) -> DataFrame:
    cols = [
        F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


@query(
    "keyword_rate_by_speaker",
    sql=f"""with {SENTENCES_SQL}, hits as (select speaker, ({word_sql('sentence', EVIDENCE)})::int::double as hit from sents)
{RATE_SQL.format(g='speaker').replace('select speaker, mean,', 'select speaker, round(mean, 6) as mean,', 1)}""",
)
def keyword_rate_by_speaker(t: Tables) -> DataFrame:
    """Share of evidence sentences per speaker with a 95 % interval."""
    s = transcripts.to_sentences(transcripts.segment(transcript_rows(t)))
    s = s.withColumn("hit", text.has_keyword(F.col("sentence"), EVIDENCE))
    return _rounded(stats.proportion_stats(s, ["speaker"], "hit"))


@query(
    "keyword_rate_by_source",
    sql=f"""with {DOC_SENTENCES_SQL}, hits as (select source, lang, ({word_sql('sentence', EVIDENCE)})::int::double as hit from dsents)
{RATE_SQL.format(g='source, lang').replace('select source, lang, mean,', 'select source, lang, round(mean, 6) as mean,', 1)}""",
)
def keyword_rate_by_source(t: Tables) -> DataFrame:
    s = transcripts.to_sentences(t.documents.select("doc_id", "lang", "source", "text"))
    s = s.withColumn("hit", text.has_keyword(F.col("sentence"), EVIDENCE))
    return _rounded(stats.proportion_stats(s, ["source", "lang"], "hit"))


@query(
    "keyword_presets",
    sql="with p(name, spec) as (values "
    + ", ".join(f"('{k}', '{v}')" for k, v in text.KEYWORD_PRESETS.items())
    + "), s as (select doc_id, text from documents)"
    + " select * from ("
    + " union all ".join(
        f"select '{k}' as preset, count_if({word_sql('text', text.parse_keywords(v))})::bigint as n_hits, count(*)::bigint as n from s"
        for k, v in text.KEYWORD_PRESETS.items()
    )
    + ")",
)
def keyword_presets(t: Tables) -> DataFrame:
    """Documents hit by each preset keyword list, in one pass."""
    docs = t.documents.select("text")
    hits = F.array(
        *[
            F.struct(
                F.lit(name).alias("preset"),
                text.has_keyword(F.col("text"), text.parse_keywords(spec)).alias("hit"),
            )
            for name, spec in text.KEYWORD_PRESETS.items()
        ]
    )
    flat = docs.select(F.explode(hits).alias("h")).select("h.preset", "h.hit")
    return flat.groupBy("preset").agg(F.count_if("hit").alias("n_hits"), F.count(F.lit(1)).alias("n"))


@query(
    "keyword_lists",
    sql="""select doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: lower(trim(x, E' \\n\\t\\r'))), lambda x: x <> ''), '|') as keywords from documents""",
)
def keyword_lists(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.keyword_list(F.col("text")), "|").alias("keywords"))


@query("search_literal", sql="select doc_id, source from documents where contains(text, 'ation')")
def search_literal(t: Tables) -> DataFrame:
    return t.documents.filter(text.search(F.col("text"), "ation", case_sensitive=True)).select("doc_id", "source")


@query("search_nocase", sql="select doc_id, source from documents where contains(lower(text), 'the ')")
def search_nocase(t: Tables) -> DataFrame:
    return t.documents.filter(text.search(F.col("text"), "The ")).select("doc_id", "source")


@query("search_word", sql=f"select doc_id, source from documents where {word_sql('text', ['the'])}")
def search_word(t: Tables) -> DataFrame:
    return t.documents.filter(text.search(F.col("text"), "the", whole_words=True)).select("doc_id", "source")


@query("search_regex", sql="select doc_id, source from documents where regexp_matches(text, '(?i)the[a-z]+ing')")
def search_regex(t: Tables) -> DataFrame:
    return t.documents.filter(text.search(F.col("text"), "the[a-z]+ing", regex=True)).select("doc_id", "source")


@query(
    "highlight",
    sql="select doc_id, md5(regexp_replace(text, '(?i)(tion|ou)', '<mark>\\1</mark>', 'g')) as digest from documents where contains(lower(text), 'ou')",
)
def highlight(t: Tables) -> DataFrame:
    d = t.documents.filter(text.search(F.col("text"), "ou"))
    return d.select("doc_id", F.md5(text.highlight(F.col("text"), "ou tion")).alias("digest"))


@query(
    "witness_filter",
    sql="""with s as (
  select c_custkey, case c_custkey % 5 when 0 then 'Dr. ' when 1 then 'Mr. ' when 2 then 'General ' when 3 then 'Senator ' else 'The Chairman' end || case when c_custkey % 5 < 4 then c_name else '' end as speaker from customer)
select speaker, c_custkey, (c_custkey % 5 in (0, 2))::int as is_witness from s""",
)
def witness_filter(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    who = (
        F.when(k == 0, F.concat(F.lit("Dr. "), "c_name"))
        .when(k == 1, F.concat(F.lit("Mr. "), "c_name"))
        .when(k == 2, F.concat(F.lit("General "), "c_name"))
        .when(k == 3, F.concat(F.lit("Senator "), "c_name"))
        .otherwise("The Chairman")
    )
    s = t.customer.select("c_custkey", who.alias("speaker"))
    return s.withColumn("is_witness", text.is_witness(F.col("speaker")).cast("int"))


@query(
    "token_chunks",
    sql="""with tk as (select doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from documents),
nz as (select doc_id, list_filter(w, lambda x: x <> '') as w from tk)
select doc_id, len(w)::bigint as n_tokens, i::bigint as chunk_no, md5(array_to_string(w[i * 500 + 1 : i * 500 + 500], ' ')) as digest
from nz, lateral (select unnest(range((len(w) + 499) // 500)) as i)""",
)
def token_chunks(t: Tables) -> DataFrame:
    d = transcripts.token_chunks(t.documents.select("doc_id", "text"), 500)
    return d.select("doc_id", "n_tokens", "chunk_no", F.md5("chunk").alias("digest"))
