"""Transcripts to speaker chunks to sentence records.

A transcript is one string, so segmentation, sentence splitting and context windows
all happen inside its row: the chain is a map-only job however long the corpus is.
Line tables (one row per line) go through `carry_speaker` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from .ordered import DEFAULT_SPAN, with_ordered


def segment(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """One row per speech: the other columns plus chunk_pos, speaker, text."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(text.speaker_chunks(F.col(text_col))).alias("chunk_pos", "_c")).select(
        *rest, F.col("chunk_pos").cast("bigint").alias("chunk_pos"), "_c.speaker", "_c.text"
    )


def segment_inline(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Speakers inside unbroken text; paragraphs are numbered from 1."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(text.inline_chunks(F.col(text_col))).alias("_p", "_c")).select(
        *rest, (F.col("_p") + 1).cast("bigint").alias("para_num"), "_c.speaker", "_c.text"
    )


def to_sentences(df: DataFrame, text_col: str = "text", *, drop_short: bool = True) -> DataFrame:
    """One row per sentence, other columns kept. Neighbours are taken before short ones go."""
    rest = [c for c in df.columns if c != text_col]
    split = df.select(*rest, text.sentences(F.col(text_col)).alias("_s"))
    out = split.select(*rest, F.explode(text.with_context(F.col("_s"))).alias("_x")).select(*rest, "_x.*")
    return out.filter(text.long_enough(F.col("sentence"))) if drop_short else out


def token_chunks(df: DataFrame, max_tokens: int, text_col: str = "text") -> DataFrame:
    """Texts cut into runs of at most `max_tokens` whitespace tokens, with the token count."""
    rest = [c for c in df.columns if c != text_col]
    split = df.select(*rest, text.tokens(F.col(text_col)).alias("_t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0)), F.lit(max_tokens))
    parts = split.filter(F.size("_t") > 0).select(
        *rest, F.size("_t").cast("bigint").alias("n_tokens"), "_t", F.posexplode(starts).alias("_i", "_at")
    )
    return parts.select(
        *rest,
        "n_tokens",
        F.col("_i").cast("bigint").alias("chunk_no"),
        F.array_join(F.slice("_t", F.col("_at") + 1, F.lit(max_tokens)), " ").alias("chunk"),
    )


def sentence_records(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Transcript rows -> sentence rows with the speaker's name parts."""
    return names.with_name_parts(to_sentences(segment(df, text_col)))


def without_sentences(hearings: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Hearings that gave no sentence at all."""
    return hearings.join(records.select(key).distinct(), key, "left_anti")


def carry_speaker(lines: DataFrame, keys: list[str], pos: str, line: str, *, span: int = DEFAULT_SPAN, block: Column | None = None) -> DataFrame:
    """Line table -> the lines spoken, each with its speaker and speech number.

    The current speaker is carried over any number of lines, and a hearing of any
    length is worked on in blocks.
    """
    kept = lines.filter(text.is_spoken_line(F.col(line))).withColumn("_mark", text.line_speaker(F.col(line)))
    kept = kept.withColumn("_is_mark", F.col("_mark").isNotNull().cast("bigint"))
    out = with_ordered(
        kept, keys, pos, span=span, block=block, running={"chunk_id": "_is_mark"}, carry={"speaker": "_mark"}
    )
    said = F.when(F.col("_mark").isNotNull(), text.line_rest(F.col(line))).otherwise(text.strip(F.col(line)))
    return (
        out.filter(F.col("speaker").isNotNull())
        .select(*keys, pos, "chunk_id", "speaker", said.alias("said"))
        .filter(F.col("said") != "")
    )
