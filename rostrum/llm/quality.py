"""Line-first quality rules: bad lines go, then documents that lost too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import computed_once

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Punctuation rule: piled-up marks, one for every four words or more.
PILED_MARKS = r"[#*$%&<>]{2,}|!{2,}|\?{3,}|[-_=~]{5,}"
WORDS_PER_PILE = 4
#: Navigation rule: separators between entries, one for every three words or more.
SEPARATOR = "[|»›•]"
WORDS_PER_SEPARATOR = 3
#: Boilerplate rule: notices that are no part of a text, in lines of this many characters at most.
NOTICES = (
    "licensed under the",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "enable javascript",
    "accept cookies",
    "uses cookies",
    "lorem ipsum",
)
NOTICE_LINE = 300
#: A document is rejected when it loses more than this share of the characters in its lines.
MAX_LOST_PERCENT = 50


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def line_fails(line: Column) -> Column:
    """A line that one of the three rules removes."""
    n = F.size(words(line))
    low = F.lower(line)
    notice = F.lit(False)
    for phrase in NOTICES:
        notice = notice | low.contains(phrase)
    piled = F.regexp_count(line, F.lit(PILED_MARKS))
    parted = F.regexp_count(line, F.lit(SEPARATOR))
    return ((piled > 0) & (piled * WORDS_PER_PILE >= n)) | ((parted > 0) & (parted * WORDS_PER_SEPARATOR >= n)) | ((F.length(line) <= NOTICE_LINE) & notice)


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from `_words`: words inside windows of WINDOW words that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, position) pairs inside
    the row brings equal windows together, so a text of n words takes n log n steps.
    """
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = computed_once(df, {"_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    df = computed_once(df, {"_windows": F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))})
    found = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = computed_once(df.drop("_hashes"), {"_placed": F.when(found, placed)})

    def again(x: Column, k: Column) -> Column:
        twin = (F.get("_placed", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("_placed", k + 1)["h"].eqNullSafe(x["h"]))
        return F.when(twin, x["i"])

    at = F.sort_array(F.array_compact(F.transform("_placed", again)))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        at,
        zero,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return computed_once(df, {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}).drop("_windows", "_placed")


def assess(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
    line_chars, clean_text, base_failed and kept.

    One narrow pass of built-in functions: no shuffle, no Python. A null text has no words
    (and is rejected as too short). Columns of these names in `docs` are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "line_chars", "clean_text", "base_failed", "kept"]
    df = docs.drop(*[c for c in made if c != text_col]).withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = computed_once(df, {"_words": words(F.col("_text")), "_lines": F.split("_text", "\n"), "n_symbols": (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long")})
    df = _repeated_words(df)
    with_word = F.filter("_lines", _has_word)
    # Lines can fail only in texts that hold one of the marks or notices; the others skip the rules.
    low = F.lower("_text")
    suspect = F.col("_text").rlike(f"{PILED_MARKS}|{SEPARATOR}")
    for phrase in NOTICES:
        suspect = suspect | low.contains(phrase)
    df = computed_once(
        df,
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_with": with_word,
            "_left": F.when(suspect, F.filter("_lines", lambda x: ~line_fails(x))).otherwise(F.col("_lines")),
            "line_chars": F.length(F.array_join("_lines", "")).cast("long"),
        },
    )
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_with") - F.size(F.array_distinct("_with"))).cast("long"),
            "lost_chars": F.col("line_chars") - F.length(F.array_join("_left", "")),
            "clean_text": F.when(F.col(text_col).isNotNull(), F.array_join("_left", "\n")),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("line_chars"))
    return df.withColumn("kept", kept).drop("_text", "_words", "_lines", "_with", "_left")


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines taken out; columns as in `docs`, n_chars brought up to date."""
    good = assess(docs).filter("kept")
    fresh = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return good.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])
