"""Term dictionaries: loading, counting, versions, variants, party gaps, collocations."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import relational as rel

# Spelling variants and the term each one counts towards.
VARIANTS = {
    "antidiscrimination": "anti-discrimination",
    "antifederalist": "anti-federalist",
    "color blindness": "colorblindness",
    "commander in chief": "commander-in-chief",
    "countermajoritarian": "counter-majoritarian",
    "delegated powers": "delegation of powers",
    "good behaviour clause": "good behavior clause",
    "void-for-vagueness": "void for vagueness",
}


def load_terms(spark: SparkSession, glob: str) -> DataFrame:
    """Numbered term lists (`…<n>.csv`, a file or a folder of files, one term per line) -> (version, term, original).

    Terms are normalized; a term repeated inside a list is kept once.
    """
    raw = spark.read.schema("original string").csv(glob).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.csv(?:/[^/]*)?$", 1).cast("int").alias("version"),
        F.trim("original").alias("original"),
    )
    return normalized_terms(raw)


def normalized_terms(raw: DataFrame) -> DataFrame:
    """(version, original) -> (version, term, original), one row per version and term."""
    terms = raw.withColumn("term", text.normalize_terms(F.col("original"))).filter(F.col("term") != "")
    return rel.first_by(terms, ["version", "term"], ["original"]).select("version", "term", "original")


def term_list(terms: DataFrame, limit: int = 5_000) -> list[str]:
    """The distinct terms as a list on the driver, `limit` at most; operators on terms take tables of any size."""
    rows = terms.select("term").distinct().orderBy("term").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} terms")
    return [r["term"] for r in rows]


class TermTrie:
    """Terms as paths of words: a state per word sequence that begins a term, steps as a sorted table of (state, word)."""

    def __init__(self, terms: list[str]):
        paths = [t.split(" ") for t in terms]
        self.words = sorted({w for p in paths for w in p})
        code = {w: i for i, w in enumerate(self.words)}
        states: dict[tuple, int] = {(): 0}
        for p in paths:
            for k in range(1, len(p) + 1):
                states.setdefault(tuple(p[:k]), len(states))
        size = max(1, len(self.words))
        steps = sorted((states[p[:-1]] * size + code[p[-1]], s) for p, s in states.items() if p)
        self.step, self.to = (np.array([x[i] for x in steps], np.int64) for i in (0, 1))
        self.term = np.full(len(states), -1, np.int64)
        self.term[[states[tuple(p)] for p in paths]] = np.arange(len(paths))
        self.longest = max(map(len, paths), default=0)

    def hits(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the terms in each row's words; a row's occurrences of a term share no word and no blank."""
        codes = pc.index_in(words.flatten(), pa.array(self.words, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        row_of = np.repeat(np.arange(len(words)), lengths)
        end = np.repeat(np.cumsum(lengths), lengths)
        at, state, size = np.flatnonzero(codes >= 0), None, max(1, len(self.words))
        state = np.zeros(len(at), np.int64)
        found = []
        for depth in range(self.longest):
            on = at + depth < end[at]
            at, state = at[on], state[on]
            word = codes[at + depth]
            key = state * size + word
            k = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            real = (self.step[k] == key) & (word >= 0)
            at, state = at[real], self.to[k[real]]
            whole = self.term[state] >= 0
            found.append((row_of[at[whole]], self.term[state[whole]], at[whole], np.full(whole.sum(), depth + 1)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        row, term, place, n = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, term, row))
        row, term, place, n = row[order], term[order], place[order], n[order]
        same = np.concatenate([[False], (row[1:] == row[:-1]) & (term[1:] == term[:-1])])
        near = same & (place - np.concatenate([[0], place[:-1]]) <= n)
        counted = np.ones(len(row), bool)
        last = -1  # the occurrence counted last, for those that follow one closely
        for i in np.flatnonzero(near).tolist():
            if not near[i - 1]:
                last = i - 1
            counted[i] = place[i] - place[last] > n[i]
            last = i if counted[i] else last
        row, term = row[counted], term[counted]
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])[: len(row)]
        return row[first], term[first], np.diff(np.append(np.flatnonzero(first), len(row)))


#: Characters of terms that are broadcast together; larger dictionaries are counted in several scans.
TRIE_CHARS = 32 << 20
#: Rows that leave a task at a time when absent terms are filled in.
FILL_ROWS = 200_000


def _dictionary_slices(terms: DataFrame | list[str]) -> Iterator[list[str]]:
    """Distinct terms, in lists of about TRIE_CHARS characters."""
    if isinstance(terms, list):
        chars = sum(map(len, terms))
        n = max(1, -(-chars // TRIE_CHARS))
        yield from (terms[k::n] for k in range(n))
        return
    some = terms.select("term").filter(F.length("term") > 0)
    n = max(1, -(-int(some.agg(F.sum(F.length("term"))).first()[0] or 0) // TRIE_CHARS))
    for k in range(n):
        yield [r[0] for r in some.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k).distinct().orderBy("term").collect()]


def term_counts(speeches: DataFrame, key: list[str], text_col: str, terms: DataFrame | list[str]) -> DataFrame:
    """(key..., term, n): whole-word counts of the terms that occur, and under a null term each key's number of words.

    Each speech is normalized and matched against a trie of words where it lies, with the whole dictionary in one
    pass over its words; only counts are shuffled. A term never spans two speeches. `terms`: a list, or a table
    with the column `term`, of any size.
    """
    norm = text.normalize_terms(F.col(text_col))
    t = F.col("_t")
    n_words = F.greatest(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    rows = speeches.select(*key, norm.alias("_t")).select(*key, "_t", n_words.alias("_w"))
    parts = []
    for k, some in enumerate(_dictionary_slices(terms)):
        shared = speeches.sparkSession.sparkContext.broadcast((some, vars(TermTrie(some))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, with_words=k == 0):
            names, state = shared.value
            trie = TermTrie.__new__(TermTrie)
            vars(trie).update(state)
            for b in batches:
                row, term, n = trie.hits(pc.split_pattern(pc.fill_null(b.column(len(key)), ""), " "))
                said = pa.array(names, pa.string()).take(pa.array(term))
                if with_words:
                    row = np.concatenate([row, np.arange(b.num_rows)])
                    said = pa.concat_arrays([said, pa.nulls(b.num_rows, pa.string())])
                    n = np.concatenate([n, b.column(len(key) + 1).fill_null(0).to_numpy(zero_copy_only=False)])
                keys = [b.column(i).take(pa.array(row)) for i in range(len(key))]
                yield pa.RecordBatch.from_arrays([*keys, said, pa.array(n, pa.int64())], names=[*key, "term", "n"])

        schema = T.StructType([*(speeches.schema[c] for c in key), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
        parts.append(rows.mapInArrow(run, schema))
    return functools.reduce(DataFrame.union, parts).groupBy(*key, "term").agg(F.sum("n").alias("n"))


def term_frequency(speeches: DataFrame, key: list[str], text_col: str, terms: list[str]) -> DataFrame:
    """Whole-word count and rate per million words of every term per hearing.

    Counts are those of `term_counts`. Terms that do not occur have a count of 0, so there are as many rows as hearings
    times terms: they are filled in beside each hearing's counts, without a join.
    """
    counts = term_counts(speeches, key, text_col, terms)
    said = F.col("term").isNotNull()
    one = F.collect_list(F.when(said, F.struct("term", "n")))
    per_key = counts.groupBy(*key).agg(F.sum(F.when(~said, F.col("n"))).alias("n_words"), one.alias("_c"))
    flat = per_key.select(*key, "n_words", F.col("_c.term").alias("_term"), F.col("_c.n").alias("_n"))
    shared = speeches.sparkSession.sparkContext.broadcast(list(terms))

    def fill(batches: Iterator[pa.RecordBatch]):
        names = pa.array(shared.value, pa.string())
        step = max(1, FILL_ROWS // max(1, len(names)))
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            found, counted = b.column(len(key) + 1), b.column(len(key) + 2)
            n = np.zeros((b.num_rows, len(names)), np.int64)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            n[row, pc.index_in(found.flatten(), names).to_numpy(zero_copy_only=False).astype(np.int64)] = counted.flatten().to_numpy(zero_copy_only=False)
            which = pa.array(np.repeat(np.arange(b.num_rows), len(names)))
            cells = [b.column(i).take(which) for i in range(len(key) + 1)]
            yield pa.RecordBatch.from_arrays([*cells, names.take(pa.array(np.tile(np.arange(len(names)), b.num_rows))), pa.array(n.ravel())], names=[*key, "n_words", "term", "n"])

    schema = T.StructType([*(speeches.schema[c] for c in key), T.StructField("n_words", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    rate = F.round(F.col("n") / F.greatest(F.col("n_words"), F.lit(1)) * 1_000_000, 3)
    return flat.mapInArrow(fill, schema).withColumn("per_million", rate)


def version_rates(freq: DataFrame, key: list[str], versions: DataFrame) -> DataFrame:
    """Mean rate per hearing over the terms of each cumulative version k (lists 1..k)."""
    last = versions.agg(F.max("version")).scalar()
    spread = versions.groupBy("term").agg(F.min("version").alias("_v"))
    spread = spread.select("term", F.explode(F.sequence(F.col("_v"), last)).alias("version"))
    return freq.join(spread, "term").groupBy(*key, "version").agg(F.avg("per_million").alias("mean_rate"))


def version_shares(rates: DataFrame) -> DataFrame:
    """Share of hearings above 0 and above the version's mean."""
    means = rates.groupBy("version").agg(F.avg("mean_rate").alias("_m"))
    r = F.col("mean_rate")
    return rates.join(means, "version").groupBy("version").agg(
        F.avg((r > 0).cast("double")).alias("above_zero"), F.avg((r > F.col("_m")).cast("double")).alias("above_mean"), F.count(r).alias("n")
    )


def merge_variants(counts: DataFrame, keys: list[str], sums: list[str], variants: dict[str, str] | None = None) -> DataFrame:
    """Counts of spelling variants added to their canonical term."""
    pairs = F.create_map(*[F.lit(x) for kv in (variants or VARIANTS).items() for x in kv])
    named = counts.withColumn("term", F.coalesce(F.try_element_at(pairs, F.col("term")), F.col("term")))
    return named.groupBy(*keys, "term").agg(*[F.sum(c).alias(c) for c in sums])


def party_gap(freq: DataFrame, party: str, words: str, count: str, first: str, second: str) -> DataFrame:
    """Per term: counts and per-million rates of two parties, and their difference."""
    def rate(p):
        return F.sum(F.when(F.col(party) == p, F.col(count))) / F.nullif(F.sum(F.when(F.col(party) == p, F.col(words))), F.lit(0)) * 1e6

    g = freq.groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col(party) == first, F.col(count))), F.lit(0)).alias("first_total"),
        F.coalesce(F.sum(F.when(F.col(party) == second, F.col(count))), F.lit(0)).alias("second_total"),
        rate(first).alias("first_rate"), rate(second).alias("second_rate"),
    )
    return g.withColumn("diff_total", F.col("first_total") - F.col("second_total")).withColumn("diff_rate", F.col("first_rate") - F.col("second_rate"))


def collocations(docs: DataFrame, text_col: str, min_count: int = 1, threshold: float = 2.0) -> DataFrame:
    """Adjacent word pairs scored (n_ab - min) * V / (n_a * n_b), V distinct words and pairs.

    Pairs and words are counted map-side before they are shuffled.
    """
    words = docs.select(F.filter(F.split(text.normalize_terms(F.col(text_col)), " "), lambda w: w != "").alias("_w"))
    single = words.select(F.explode("_w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    size = F.size("_w")
    pairs = words.filter(size > 1).select(
        F.explode(
            F.zip_with(F.slice("_w", F.lit(1), size - 1), F.slice("_w", F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        ).alias("p")
    )
    both = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_ab"))
    vocab = single.agg(F.count(F.lit(1))).scalar() + both.agg(F.count(F.lit(1))).scalar()
    scored = (
        both.filter(F.col("n_ab") >= min_count)
        .join(single.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a")
        .join(single.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
    )
    score = (F.col("n_ab") - min_count).cast("double") / F.col("n_a") / F.col("n_b") * vocab
    return scored.withColumn("score", score).filter(F.col("score") > threshold)
