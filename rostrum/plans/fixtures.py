"""Stand-ins for hearing tables, derived by Spark from the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Tables

# ---- transcripts ------------------------------------------------------------

def transcripts(t: Tables) -> DataFrame:
    """One transcript per conversation turn: (conv_id, turn, raw_text)."""
    who = (
        F.when(F.col("role") == "user", "Mr. Smith")
        .when(F.col("role") == "assistant", "Ms. Van Orden")
        .otherwise("The Chairman")
    )
    return t.conversations.select(
        "conv_id",
        "turn",
        F.concat(F.lit("    "), who, F.lit(". "), F.col("text"), F.lit("\nContents .... 5\n")).alias("raw_text"),
    )


TRANSCRIPTS_SQL = """
tr as (
  select conv_id, turn,
         '    ' || case role when 'user' then 'Mr. Smith' when 'assistant' then 'Ms. Van Orden'
                             else 'The Chairman' end
         || '. ' || text || chr(10) || 'Contents .... 5' || chr(10) as raw_text
  from conversations),
raw_lines as (
  select conv_id, turn, unnest(string_split(raw_text, chr(10))) as line,
         unnest(range(len(string_split(raw_text, chr(10))))) as ln
  from tr),
marked as (
  select *, nullif(regexp_extract(line,
    '^\\s{2,}((?:Mr|Mrs|Ms|Senator)\\.?\\s+[A-Z][A-Za-z''-]+(?:\\s+[A-Za-z''-]+)*|(?i:The\\s+Chair(?:man|woman)))\\.', 1), '') as mark
  from raw_lines
  where not contains(line, '....') and regexp_matches(line, '\\S')),
numbered as (
  select *, sum((mark is not null)::int) over (partition by conv_id, turn order by ln) as chunk_no
  from marked),
chunks as (
  select conv_id, turn, chunk_no::bigint - 1 as chunk_pos, max(mark) as speaker,
         string_agg(nullif(trim(regexp_replace(line,
           '^\\s{2,}((?:Mr|Mrs|Ms|Senator)\\.?\\s+[A-Z][A-Za-z''-]+(?:\\s+[A-Za-z''-]+)*|(?i:The\\s+Chair(?:man|woman)))\\.', '')), ''),
           ' ' order by ln) as text
  from numbered where chunk_no > 0 group by conv_id, turn, chunk_no)
"""


def split_sql(text: str) -> str:
    """SQL for the sentence rule; two passes stand in for the look-behind."""
    held = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    for _ in range(2):
        held = (
            f"regexp_replace({held}, '(^|[ (' || chr(3) || '])(Mr|Mrs|Ms|Dr|No|U\\.S|[A-Z])\\. ', "
            f"'\\1\\2.' || chr(3), 'g')"
        )
    cut = f"regexp_replace({held}, '([.!?]) ', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: replace(x, chr(3), ' ')), lambda x: x <> '')"


SENTENCES_SQL = (
    TRANSCRIPTS_SQL
    + f""",
parts as (select conv_id, turn, chunk_pos, speaker, {split_sql('text')} as ss from chunks),
flat as (
  select conv_id, turn, chunk_pos, speaker, unnest(ss) as sentence, unnest(range(len(ss))) as sent_pos from parts),
ctx as (
  select conv_id, turn, chunk_pos, speaker, sent_pos::bigint as sent_pos, sentence,
         coalesce(lag(sentence) over w, '') as context_before,
         coalesce(lead(sentence) over w, '') as context_after
  from flat window w as (partition by conv_id, turn, chunk_pos order by sent_pos)),
sents as (select * from ctx where length(trim(sentence)) >= 5)
"""
)

DOC_SENTENCES_SQL = f"""
dparts as (select doc_id, lang, source, {split_sql('text')} as ss from documents),
dsents as (
  select * from (
    select doc_id, lang, source, unnest(ss) as sentence, unnest(range(len(ss))) as sent_pos from dparts)
  where length(trim(sentence)) >= 5)
"""


def word_sql(col: str, words: list[str]) -> str:
    """Whole-word, case-insensitive test: the text's word list meets the keywords."""
    plain = [w for w in words if w.isalnum()]
    tests = [
        f"list_has_any(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), ["
        + ", ".join(f"'{w}'" for w in plain)
        + "])"
    ]
    for w in words:
        if not w.isalnum():
            tests.append(f"contains(lower({col}), '{w}')")
    return "(" + " or ".join(tests) + ")"


# ---- congress-like numbering ---------------------------------------------------


def congress_of(date_col: str | Column) -> Column:
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.floor((F.year(c) - 1789) / 2).cast("int") + 1


def congress_sql(col: str) -> str:
    return f"((year({col}) - 1789) // 2 + 1)"


def orders_c(t: Tables) -> DataFrame:
    return t.orders.withColumn("congress", congress_of("o_orderdate"))
