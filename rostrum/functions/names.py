"""Name, title and identifier expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .barrier import computed_once
from .text import squeeze, strip

# Title words removed from a speaker's name.
TITLE_WORDS = (
    "MR MRS MS DR CHAIRMAN CHAIRWOMAN CHAIRPERSON SENATOR REPRESENTATIVE GENERAL ADMIRAL "
    "SECRETARY JUDGE AMBASSADOR GOVERNOR MAYOR PROFESSOR REVEREND FATHER THE"
).split()
# Names that stand for a committee chair.
CHAIR_NAMES = ("CHAIRMAN", "CHAIRWOMAN", "CHAIRPERSON")
# Words that stay lower case inside a title.
SMALL_WORDS = "a an and are as at be but by en for if in is nor not of on or per so the to v via from into than that with".split()


def _plain_words(speaker) -> Column:
    """Upper-case words without the full stops at their ends."""
    blank = F.regexp_replace(F.upper(speaker), r"(?U)[\s&&[^ ]]", " ")
    return F.filter(F.transform(F.split(blank, " "), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def with_name_parts(df: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Add speaker_last_name (upper case, titles removed) and speaker_last_word.

    A speaker of nothing but titles keeps the last one; an empty speaker gives null.
    """
    plain = computed_once(df, {"_words": _plain_words(F.col(speaker))})
    bare = F.array_join(F.filter("_words", lambda w: ~w.isin(*TITLE_WORDS)), " ")
    full = F.coalesce(F.nullif(bare, F.lit("")), F.try_element_at("_words", F.lit(-1)))
    named = computed_once(plain, {"speaker_last_name": full}).drop("_words")
    return named.withColumn("speaker_last_word", F.substring_index("speaker_last_name", " ", -1))


def parent_committee(code) -> Column:
    """House-style code such as hsag00 -> HSAG; sub-committees and bad codes -> ''."""
    return F.when(
        (F.length(code) >= 6) & (F.substring(code, 5, 2) == "00"), F.upper(F.substring(code, 1, 4))
    ).otherwise("")


def simple_title(col) -> Column:
    """Lower case, no punctuation, single blanks."""
    return squeeze(F.regexp_replace(F.lower(col), r"(?U)[^\w\s]", ""))


def trimmed_lower(col) -> Column:
    return F.lower(strip(col))


def first_words(col, n: int) -> Column:
    """First n words in lower case, or the whole title when it has fewer."""
    words = F.split(squeeze(F.lower(col)), " ")
    return F.array_join(F.slice(words, 1, n), " ")


def joined_key(*cols) -> Column:
    """Composite key; a missing part reads NA."""
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("NA")) for c in cols])


def package_id(file_name) -> Column:
    return F.upper(F.regexp_replace(file_name, r"\.txt$", ""))


def title_case(col) -> Column:
    """Capitalise words except small ones that are not first."""
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])
    words = F.split(F.lower(col), " ")
    return F.array_join(
        F.transform(
            words,
            lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(
                F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30))
            ),
        ),
        " ",
    )


def without_prefix(col, prefix: str) -> Column:
    return F.replace(col, F.lit(prefix), F.lit(""))


def capitalized(col) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 2**30)))


def zero_padded(col, width: int = 5) -> Column:
    """Numeric text -> integer text padded with zeros; anything else -> null."""
    n = col.try_cast("double").try_cast("bigint")
    return F.lpad(n.cast("string"), width, "0")


def letter_bag(col) -> Column:
    """Letters with their occurrence number, so that set overlap counts repeated letters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(
        F.sequence(F.lit(1), F.length(c)),
        lambda i: F.concat(
            F.substr(c, i, F.lit(1)),
            (i - F.length(F.replace(F.substr(c, F.lit(1), i), F.substr(c, i, F.lit(1)), F.lit("")))).cast("string"),
        ),
    )


def long_similarity(a, b) -> Column:
    """`similarity` in Arrow batches, for strings whose length makes the column form dear.

    The common subsequence grows a bit per letter in one integer; a pair takes steps in the length
    of one string only. Null if either string is.
    """

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y):
            if one is None or two is None:
                out.append(None)
                continue
            at: dict[str, int] = {}
            for i, letter in enumerate(one):
                at[letter] = at.get(letter, 0) | 1 << i
            full = open_ = (1 << len(one)) - 1
            for letter in two:
                hit = open_ & at.get(letter, 0)
                open_ = (open_ + hit | open_ - hit) & full
            common, total = (full & ~open_).bit_count(), len(one) + len(two)
            out.append(200.0 * common / total if total else 100.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double").asNondeterministic()(a, b)


def similarity(a, b) -> Column:
    """0-100 similarity: 200 * longest common subsequence / total length.

    Two empty strings are equal (100); one empty string scores 0.
    """
    first_row = F.array_repeat(F.lit(0), F.length(b) + 1)

    def next_row(prev, i):
        def step(acc, j):
            same = F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))
            best = F.when(same, F.element_at(prev, j) + 1).otherwise(
                F.greatest(F.element_at(prev, j + 1), F.element_at(acc, F.lit(-1)))
            )
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), step)

    rows = F.aggregate(F.sequence(F.lit(1), F.length(a)), first_row, next_row)
    total = F.length(a) + F.length(b)
    return (
        F.when(total == 0, F.lit(100.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.element_at(rows, F.lit(-1)) * F.lit(200.0) / total)
    )
