"""Transcript and keyword expressions. Everything here is a JVM-side column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that open a speaker line, and the title words stripped from names.
SPEAKER_TITLES = (
    "Mr Mrs Ms Dr Chairman Chairwoman Chairperson Senator Representative General Admiral "
    "Secretary Judge Ambassador Governor Mayor Professor Reverend Father"
).split()
# Prefixes that mark a legislator rather than a witness.
LEGISLATOR_PREFIXES = (
    "Mr.",
    "Mrs.",
    "Ms.",
    "Chairman",
    "Chairwoman",
    "The Chairman",
    "The Chairwoman",
    "Senator",
    "Representative",
)
# Keyword presets for evidence-based speech.
KEYWORD_PRESETS = {
    "core": "data, evidence, statistics, statistical, study, report, research, analysis, percent, %, "
    "number, increase, decrease, caused, correlation, fact, empirical",
    "science": "data, evidence, statistics, statistical, study, report, research, analysis, percent, %, "
    "scientific, study, publication, peer-reviewed, laboratory",
    "economics": "deficit, inflation, revenue, budget, cost, gdp, dollars, billion, million, tax, "
    "interest, employment, trade, gross, market",
    "causality": "caused, correlation, effect, because, result, consequence, fact, empirical, prove, "
    "demonstration, findings, variable, experimental",
}
# Titles before a name and titles that stand alone, in unbroken text.
INLINE_TITLES, INLINE_ALONE = ("Mr", "Ms", "Senator"), ("CHAIRMAN", "CHAIRWOMAN")
# Abbreviations after which a full stop does not end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "No", r"U\.S")

MIN_SENTENCE_CHARS = 5
_CHUNK, _BODY, _HELD = "\u0001", "\u0002", "\u0003"
_GAP = r"[^\S\n]"

# One speaker header at the start of a line; group 1 is the speaker.
SPEAKER_HEADER = (
    rf"(?dmU)^{_GAP}{{2,}}((?:{'|'.join(SPEAKER_TITLES)})\.?{_GAP}+[A-Z][A-Za-z'\-]+"
    rf"(?:{_GAP}+[A-Za-z'\-]+)*|(?i:The{_GAP}+Chair(?:man|woman)))\."
)


def strip(col) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def squeeze(col) -> Column:
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def without_contents_lines(text) -> Column:
    """Blank the lines of a table of contents, recognised by a run of four dots."""
    return F.regexp_replace(text, r"(?dm)^[^\n]*\.{4}[^\n]*$", "")


def speaker_chunks(text) -> Column:
    """Transcript -> array<struct<speaker, text>>, in order, without a shuffle.

    Text before the first speaker and speakers who say nothing are left out.
    """
    plain = F.translate(text, _CHUNK + _BODY + _HELD, "")
    marked = F.regexp_replace(without_contents_lines(plain), SPEAKER_HEADER, f"{_CHUNK}$1{_BODY}")
    parts = F.slice(F.split(marked, _CHUNK), 2, 2**31 - 2)
    chunks = F.transform(
        parts,
        lambda p: F.struct(
            strip(F.substring_index(p, _BODY, 1)).alias("speaker"),
            strip(
                F.regexp_replace(
                    F.regexp_replace(p, f"(?s)^[^{_BODY}]*{_BODY}", ""), r"(?U)\s*\n\s*", " "
                )
            ).alias("text"),
        ),
    )
    return F.filter(chunks, lambda c: c["text"] != "")


def line_speaker(line) -> Column:
    """Speaker named at the start of a single line, else null."""
    return F.nullif(F.regexp_extract(line, SPEAKER_HEADER, 1), F.lit(""))


def line_rest(line) -> Column:
    """The line without its speaker header."""
    return strip(F.regexp_replace(line, SPEAKER_HEADER, ""))


def is_spoken_line(line) -> Column:
    return (F.instr(line, "....") == 0) & line.rlike(r"(?U)\S")


def sentences(text) -> Column:
    """Rule-based sentence split -> array<string>; abbreviations and initials are kept together."""
    t = squeeze(F.translate(text, _CHUNK + _BODY + _HELD, ""))
    held = F.regexp_replace(
        t, rf"(?<![^ ({_HELD}])({'|'.join(ABBREVIATIONS)}|[A-Z])\. ", rf"$1.{_HELD}"
    )
    cut = F.regexp_replace(held, r"([.!?]) ", rf"$1{_CHUNK}")
    parts = F.transform(F.split(cut, _CHUNK), lambda s: F.translate(s, _HELD, " "))
    return F.filter(parts, lambda s: s != "")


def with_context(sents) -> Column:
    """array<string> -> array<struct<sent_pos, context_before, sentence, context_after>>."""
    return F.transform(
        sents,
        lambda s, i: F.struct(
            i.cast("bigint").alias("sent_pos"),
            F.coalesce(F.get(sents, i - 1), F.lit("")).alias("context_before"),
            s.alias("sentence"),
            F.coalesce(F.get(sents, i + 1), F.lit("")).alias("context_after"),
        ),
    )


def long_enough(sentence) -> Column:
    return F.length(strip(sentence)) >= MIN_SENTENCE_CHARS


def inline_chunks(text) -> Column:
    """Unbroken text -> array<struct<speaker, text>>; text before the first marker is `Unknown`."""
    titled, alone = "|".join(INLINE_TITLES), "|".join(INLINE_ALONE)
    # A chair's title may end a longer word, a titled name may run on; both as in the sources.
    marker = rf"(?U)\b(?:{titled})\s+[A-Z]{{2,}}|(?:{alone})\b"
    marked = F.regexp_replace(F.translate(text, _CHUNK + _BODY, ""), marker, f"{_CHUNK}$0{_BODY}")
    pieces = F.split(marked, _CHUNK)
    rows = F.transform(
        pieces,
        lambda p: F.struct(
            F.when(F.instr(p, _BODY) > 0, F.substring_index(p, _BODY, 1)).otherwise("Unknown").alias("speaker"),
            F.when(F.instr(p, _BODY) > 0, F.substring_index(p, _BODY, -1)).otherwise(p).alias("raw"),
        ),
    )
    kept = F.filter(rows, lambda r: r["raw"] != "")
    return F.transform(kept, lambda r: F.struct(r["speaker"].alias("speaker"), strip(r["raw"]).alias("text")))


def is_witness(speaker, ignore_case: bool = False) -> Column:
    """True unless the speaker carries a legislator's title. Null counts as a witness."""
    s = F.coalesce(speaker, F.lit(""))
    if ignore_case:
        s = F.lower(s)
    hit = F.lit(False)
    for prefix in LEGISLATOR_PREFIXES:
        hit = hit | s.startswith(prefix.lower() if ignore_case else prefix)
    return ~hit


def _edges(term: str, whole_words: bool = True) -> tuple[str, str]:
    """What `bounded` puts before and behind a term."""
    # Next to a word character of the term there must be none in the text.
    before, after = (r"(?<!\w)" if term[:1].isalnum() or term[:1] == "_" else ""), (r"(?!\w)" if term[-1:].isalnum() or term[-1:] == "_" else "")
    return (before, after) if whole_words else ("", "")


def bounded(term: str, whole_words: bool = True) -> str:
    """Regex for a literal term; word boundaries only where the edge is a word character."""
    before, after = _edges(term, whole_words)
    return f"{before}{re.escape(term)}{after}"


def _any_of(terms: list[str], whole_words: bool = True) -> str:
    """Regex that is found where any of the literal terms is found, bounded as by `bounded`.

    A place in the text is looked at once for all terms: first its letter, then what is before it, then the terms.
    """
    if not all(terms):
        return ""  # the empty term is found in any text
    groups: dict[tuple[str, str], list[str]] = {}
    for term in terms:
        groups.setdefault(_edges(term, whole_words), []).append(re.escape(term))
    starts = "".join(rf"\x{{{ord(c):x}}}" for c in sorted({t[0] for t in terms}))
    return rf"(?=[{starts}])(?:" + "|".join(f"{before}(?:{'|'.join(some)}){after}" for (before, after), some in groups.items()) + ")"


def _flags(case_sensitive: bool) -> str:
    return "(?U)" if case_sensitive else "(?iuU)"


def parse_keywords(spec: str) -> list[str]:
    """Comma-separated keywords -> clean lower-case list."""
    return [k for k in (part.strip().lower() for part in spec.split(",")) if k]


def keyword_list(col) -> Column:
    """The same as `parse_keywords`, for a column."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def has_keyword(text, keywords: list[str], whole_words: bool = True) -> Column:
    if not keywords:
        return F.lit(False)
    return F.coalesce(text.rlike(_flags(False) + _any_of(keywords, whole_words)), F.lit(False))


def search(text, query: str, *, case_sensitive=False, whole_words=False, regex=False) -> Column:
    """Search predicate: literal, whole word, or regular expression."""
    if regex:
        hit = text.rlike(_flags(case_sensitive) + query)
    elif whole_words:
        hit = text.rlike(_flags(case_sensitive) + bounded(query))
    elif case_sensitive:
        hit = F.contains(text, F.lit(query))
    else:
        hit = F.contains(F.lower(text), F.lit(query.lower()))
    return F.coalesce(hit, F.lit(False))


def highlight(text, query: str, *, case_sensitive=False, whole_words=False, regex=False) -> Column:
    """Wrap each hit in <mark>; of several terms the longest is tried first."""
    if regex:
        body = rf"\b({query})\b" if whole_words else f"({query})"
    else:
        terms = sorted(query.split(), key=len, reverse=True)
        if not terms:
            return text
        body = "(" + "|".join(bounded(t, whole_words) for t in terms) + ")"
    return F.regexp_replace(text, _flags(case_sensitive) + body, "<mark>$1</mark>")


def token_count(text) -> Column:
    t = squeeze(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("bigint")


def tokens(text) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda t: t != "")


def normalize_terms(text) -> Column:
    """Dictionary normal form: lower case, dashes to blanks, letters and digits only."""
    t = F.replace(F.lower(text), F.lit("-"), F.lit(" "))
    t = F.regexp_replace(t, "[^A-Za-z0-9 ]+", "")
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def count_substring(text, needle) -> Column:
    """Number of non-overlapping occurrences of a non-empty needle."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (gone / F.length(needle)).cast("bigint")
