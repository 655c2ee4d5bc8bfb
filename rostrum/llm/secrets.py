"""Secret spans: fixed patterns, and a battery of randomness tests with false-discovery control.

Built-in functions only. Spans are (start, end) in code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import computed_once

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 12

#: Candidates of the battery: runs of encoding characters with letters and digits. '=' only pads a
#: token's end, so a value right behind `name=` is a token of its own.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: A token with characters of both groups fits no encoding; its runs without one of them are tested.
GLUE = ("[+/]", "[_-]")
RUNS = (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+={0,2}", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+={0,2}")
#: Encodings by the first pattern that fits, with their alphabets in order.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + LOWER[:6].upper()),
    ("^[A-Z2-7]+$", LOWER.upper() + "234567"),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Z0-9]+$", DIGITS + LOWER.upper()),
    ("^[A-Za-z0-9+/]+$", LOWER.upper() + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", LOWER.upper() + LOWER + DIGITS + "-_"),
)
#: How ordinary identifiers spread over character groups: (group, share, members).
TEXT_MODEL = (("[etaoinshrd]", 0.70, 10), ("[bcfgjklmpquvwxyz]", 0.16, 16), ("[A-Z]", 0.06, 26), ("[0-9]", 0.05, 10), ("[+/_-]", 0.03, 4))
#: A random token stays within this many standard deviations in each of the three tests.
MAX_SIGMA = 3.3
#: False-discovery level, shared out by token length: short tokens carry less evidence and get less.
LEVELS = ((20, 32, 0.002), (32, 64, 0.003), (64, 1 << 30, 0.005))
#: Code points of the pieces that a text is cut into before spans are taken out.
PIECE = 4_096


def let(value: Column, fn) -> Column:
    """`fn(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _running(x: Column, fold=lambda a, b: a + b) -> Column:
    """Running sums (or another fold that 0 leaves unchanged) of an int array. In blocks of about the root of its length,
    inside each and then over the blocks, so that appending copies n * sqrt(n) elements and not n * n."""
    empty = F.array().cast("array<int>")
    width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(x))).cast("int"))

    def last(a: Column) -> Column:
        return F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))

    def inside(block: Column) -> Column:
        return F.aggregate(block, empty, lambda acc, v: F.concat(acc, F.array(fold(last(acc), v))))

    def spread(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(fold(last(acc), last(b)))))
        return let(offsets, lambda off: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: fold(F.get(off, i), v)))))

    starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int"))
    blocks = F.transform(starts, lambda b: inside(F.slice(x, b * width + 1, width)))
    return F.when(F.size(x) == 0, empty).otherwise(let(blocks, spread))


def find(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, kind, end, value).

    What lies between matches is what `split` leaves, so starts are running sums of lengths.
    """
    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def place(f: Column) -> Column:
        steps = F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["hits"])), f["hits"], lambda g, h: g + F.length(h))
        ends = let(steps, lambda s: _running(s))
        rows = let(
            ends,
            lambda e: F.zip_with(
                F.arrays_zip(e.alias("end"), f["hits"].alias("hit")),
                f["values"],
                lambda x, v: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), v.alias("value")),
            ),
        )
        return rows

    return F.when(text.rlike(pattern), let(found, place)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _runs_z(codes: Column, half: Column) -> Column:
    """Wald-Wolfowitz z of the runs above and below the middle of the alphabet."""
    n = F.size(codes).cast("double")
    high = F.size(F.filter(codes, lambda v: v >= half)).cast("double")
    low = n - high
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: (a >= half) != (b >= half))
    runs = 1 + F.size(F.filter(pairs, lambda x: x))
    mean = 2 * high * low / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return F.when(var > 0, (runs - mean) / F.sqrt(var)).otherwise(F.lit(99.0))


def _serial_z(codes: Column, size: Column) -> Column:
    """Lag-one correlation of the code values times the root of their number."""
    mid = (size - 1) / 2.0
    var = (size * size - 1) / 12.0
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: (a - mid) * (b - mid))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) / (var * F.sqrt(F.size(codes).cast("double")))


def _uniform_z(token: Column, size: Column) -> Column:
    """Chi-squared of the alphabet's counts against equal shares, as a normal deviate (Wilson-Hilferty)."""
    n = F.length(token).cast("double")
    squares = F.aggregate(
        F.array_distinct(F.split(token, "")),
        F.lit(0.0),
        lambda acc, c: acc + F.pow((n - F.length(F.replace(token, c, F.lit("")))), F.lit(2.0)),
    )
    df = size - 1.0
    chi = squares * size / n - n
    scaled = F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3))
    return (scaled - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def _evidence(token: Column, size: Column) -> Column:
    """Log-likelihood of uniform over ordinary text; exp(-evidence) bounds the p value of ordinary text."""
    total = F.lit(0.0)
    for group, share, members in TEXT_MODEL:
        total = total + F.regexp_count(token, F.lit(group)) * (-F.log(size) - math.log(share / members))
    return total


def battery(token: Column) -> Column:
    """(uniform_z, runs_z, serial_z, evidence) of a token under its inferred encoding; null if none fits."""
    bare = F.regexp_replace(token, "=+$", "")
    alphabet = F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        alphabet = F.when(bare.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tests(x: Column) -> Column:
        size = F.length(x["alphabet"]).cast("double")
        codes = F.transform(F.split(x["bare"], ""), lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
        mixed = x["bare"].rlike("[0-9]") & x["bare"].rlike("[A-Za-z]") & (F.length(x["bare"]) >= 20)
        return F.when(
            mixed & x["alphabet"].isNotNull(),
            let(
                codes,
                lambda c: F.struct(
                    _uniform_z(x["bare"], size).alias("uniform_z"),
                    _runs_z(c, size / 2).alias("runs_z"),
                    _serial_z(c, size).alias("serial_z"),
                    _evidence(x["bare"], size).alias("evidence"),
                ),
            ),
        )

    return let(F.struct(bare.alias("bare"), alphabet.alias("alphabet")), tests)


def _discoveries(tested: Column) -> Column:
    """Benjamini-Hochberg within each length band of a document's candidates."""

    def band(lo: int, hi: int, level: float) -> Column:
        own = F.filter(tested, lambda x: (F.length(x["value"]) >= lo) & (F.length(x["value"]) < hi))

        def keep(rows: Column) -> Column:
            ordered = F.sort_array(F.transform(rows, lambda r: r["test"]["evidence"]), asc=False)
            passing = F.transform(ordered, lambda e, i: F.when(-e <= F.log((i + 1) * F.lit(level) / F.size(rows)), e))
            return let(F.array_min(F.array_compact(passing)), lambda least: F.filter(rows, lambda r: F.coalesce(r["test"]["evidence"] >= least, F.lit(False))))

        return let(own, keep)

    return F.concat(*[band(*x) for x in LEVELS])


def _candidates(found: Column) -> Column:
    """The tokens, and in place of one that fits no encoding its maximal runs of one alphabet, which may overlap."""

    def runs(x: Column) -> Column:
        own = F.concat(*[find(x["value"], pattern, 3) for pattern in RUNS])
        return F.transform(own, lambda r: F.struct((x["start"] + r["start"]).alias("start"), r["kind"].alias("kind"), (x["start"] + r["end"]).alias("end"), r["value"].alias("value")))

    glued = lambda x: x["value"].rlike(GLUE[0]) & x["value"].rlike(GLUE[1])
    return F.flatten(F.transform(found, lambda x: F.when(glued(x), runs(x)).otherwise(F.array(x))))


def random_tokens(text: Column) -> Column:
    """Spans of tokens that look random: they fit the uniform law in all three tests, and ordinary
    text is rejected at the false-discovery level of their length."""

    def judge(tokens: Column) -> Column:
        return let(_candidates(tokens), tried)

    def tried(found: Column) -> Column:
        tested = F.filter(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), battery(x["value"]).alias("test"))), lambda x: x["test"].isNotNull())

        def consistent(x: Column) -> Column:
            t = x["test"]
            return (t["uniform_z"] <= MAX_SIGMA) & (F.abs(t["runs_z"]) <= MAX_SIGMA) & (F.abs(t["serial_z"]) <= MAX_SIGMA)

        good = let(tested, lambda t: F.filter(_discoveries(t), consistent))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(TOKEN), let(find(text, TOKEN, 3), judge)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `base_spans` and `spans`, arrays of (start, kind, end) sorted; kind indexes KINDS.

    Every whole text is searched in one narrow pass. A null or empty text has no spans. Base spans
    always stay; the battery only adds. Columns called base_spans or spans are replaced.
    """
    df = docs.drop("base_spans", "spans").withColumn("_scanned", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col("_scanned")

    def bare(rows: Column) -> Column:
        return F.transform(rows, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    assign = bare(F.filter(find(text, ASSIGN, 0, 1), lambda x: F.length(x["value"]) >= MIN_VALUE))
    base = F.sort_array(F.concat(assign, bare(find(text, ACCESS, 1)), bare(find(text, HEX, 2))))
    df = computed_once(df, {"base_spans": base, "_random": random_tokens(text)})
    return df.withColumn("spans", F.sort_array(F.concat("base_spans", "_random"))).drop("_scanned", "_random")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


MASK = "[SECRET]"


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """The text from code point a up to b, from its pieces of PIECE code points."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    head = F.substring(F.get(pieces, i), a % PIECE + 1, F.lit(PIECE))
    body = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    tail = F.coalesce(F.substring(F.get(pieces, j), F.lit(1), b % PIECE), F.lit(""))
    inside = F.substring(F.get(pieces, i), a % PIECE + 1, b - a)
    return F.when(a >= b, "").when(i == j, inside).otherwise(F.concat(head, body, tail))


def masked(text: Column, spans: Column) -> Column:
    """`text` with MASK in place of the spans, sorted by their start; overlapping ones share a mask.

    What lies between the spans is taken from pieces of the text, so a span costs no more far into a long text.
    """
    def cut(x: Column) -> Column:
        n = F.size(x["starts"])
        opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(x["starts"], i) >= F.get(x["reach"], i - 1)))

        def join(first: Column) -> Column:
            groups = F.size(first)

            def gap(k: Column) -> Column:
                upto = F.coalesce(F.get(first, k), n)
                begin = F.when(k == 0, F.lit(0)).otherwise(F.get(x["reach"], upto - 1))
                end = F.when(k < groups, F.get(x["starts"], upto)).otherwise(x["length"])
                return _between(x["pieces"], begin, end)

            return F.array_join(F.transform(F.sequence(F.lit(0), groups), gap), MASK)

        return let(opens, join)

    parts = F.struct(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)).alias("pieces"),
        F.transform(spans, lambda s: s["start"]).alias("starts"),
        _running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("reach"),
        F.length(text).alias("length"),
    )
    return F.when(F.size(spans) > 0, let(parts, cut)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by MASK; overlapping spans share one. n_chars is brought up to date."""
    df = computed_once(scan(docs), {"_fresh": masked(F.col("text"), F.col("spans"))})
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("_fresh").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.size("spans") > 0, F.length("_fresh").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
