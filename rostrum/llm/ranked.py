"""Ranked lexical search: NRA over impact-sorted lists, one set of lists per block of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents whose lists are in memory together; a task goes through its documents block by block.
BLOCK = 4_096
#: Postings that the first round reads from each list; every later round reads twice as many.
FIRST_READ = 64
#: Benchmark text that is collected and broadcast at a time; more takes further passes.
ITEM_CHARS = 4_000_000
#: Survivors of tasks meet in this many groups an item before the last cut.
SALT = 64

#: ASCII characters that end a term become blanks, A-Z become a-z; other bytes of UTF-8 stay.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c < 0x3A or 0x61 <= c < 0x7B else c + 32 if 0x41 <= c < 0x5B else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any other non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Lists:
    """Impact-sorted lists of a block: of term t, postings begin[t] up to begin[t + 1]."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))


def nra(lists: Lists, wanted: np.ndarray, k: int, least: int = 0, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that can be among the best `k`, all of a score of at least `least` and above 0.

    Every round reads the next stretch of each term's list. A document's score lies between the sum
    of what was read of it and that sum plus the last impact read of each list it was not yet seen in.
    Reading ends when every document whose upper bound reaches the k-th best lower bound is known
    exactly: membership and ties are settled and no score is an estimate.
    """
    lo, hi = lists.begin[wanted], lists.begin[wanted + 1]
    lo, hi = lo[hi > lo], hi[hi > lo]
    lower = np.zeros(lists.n_docs, np.int64)
    if not len(lo):
        return np.zeros(0, np.int64), lower[:0]
    unseen = np.ones((len(lo), lists.n_docs), np.int64)
    frontier = np.empty(len(lo), np.int64)
    at, step = lo.copy(), first_read
    bar = max(least, 1)
    while True:
        for t in range(len(lo)):
            upto = min(at[t] + step, hi[t])
            if upto > at[t]:
                docs = lists.doc[at[t] : upto]  # a document stands in a list once
                lower[docs] += lists.impact[at[t] : upto]
                unseen[t, docs] = 0
            at[t] = upto
            frontier[t] = lists.impact[upto - 1] if upto < hi[t] else 0
        step *= 2
        if lists.n_docs > k:
            bar = max(bar, int(np.partition(lower, lists.n_docs - k)[lists.n_docs - k]))
        open_lists = np.flatnonzero(frontier)
        rest = frontier[open_lists] @ unseen[open_lists]
        # A list that is not read to its end may hold a document at no more than its frontier.
        if not np.any((rest > 0) & (lower + rest >= bar)):
            break
    found = np.flatnonzero(lower >= bar)
    return found, lower[found]


class Query:
    """The items of a pass: their terms, numbered, and who asks for which."""

    def __init__(self, rows: list[tuple]):
        self.rows = [r[0] for r in rows]
        own = [sorted(set(terms(r[1]))) for r in rows]
        self.terms = sorted(set().union(*own)) if own else []
        number = {t: i for i, t in enumerate(self.terms)}
        self.wanted = [np.array([number[t] for t in ts], np.int64) for ts in own]


def _counts(number: dict[bytes, int], text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """A document's number of terms, and which of the asked terms it holds how often."""
    words = terms(text)
    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    held, tf = np.unique(ids[ids >= 0], return_counts=True)
    return len(words), held, tf


def _statistics(docs: DataFrame, query: Query) -> tuple[int, int, np.ndarray]:
    """Over all documents: how many have a term, all their terms, and in how many each asked term is."""
    shared = docs.sparkSession.sparkContext.broadcast(query.terms)

    def run(batches: Iterator[pa.RecordBatch]):
        number = {t: i for i, t in enumerate(shared.value)}
        total, n_docs, df = 0, 0, np.zeros(len(number), np.int64)
        for batch in batches:
            for text in batch.column(1):
                n, held, _ = _counts(number, text.as_py())
                total, n_docs = total + n, n_docs + (n > 0)
                df[held] += 1
        some = np.flatnonzero(df)
        what = np.concatenate([[-2, -1], some])
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.int64()), pa.array(np.concatenate([[n_docs, total], df[some]]), pa.int64())], ["what", "n"])

    sums = dict(docs.mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n")).collect())
    df = np.array([sums.get(i, 0) for i in range(len(query.terms))], np.int64)
    return sums.get(-2, 0), sums.get(-1, 0), df


def _searched(docs: DataFrame, query: Query, k: int, block: int) -> DataFrame:
    """(item, doc_id, score): the best `k` of each task's documents, and whatever ties with them in a block."""
    n_docs, total, df = _statistics(docs, query)
    w = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((query.terms, query.wanted, w))

    def run(batches: Iterator[pa.RecordBatch]):
        names, wanted, weights = shared.value
        number = {t: i for i, t in enumerate(names)}
        best: list[list[tuple]] = [[] for _ in wanted]
        ids, held, tfs, lengths = [], [], [], []

        def settle():
            size = np.array([len(h) for h in held], np.int64)
            doc = np.repeat(np.arange(len(ids)), size)
            m = np.repeat(np.array([100 - 90 + (90 * n * n_docs) // max(total, 1) for n in lengths], np.int64), size)
            term = np.concatenate(held) if held else np.zeros(0, np.int64)
            tf = np.concatenate(tfs) if tfs else term
            lists = Lists(term, doc, impacts(weights[term], tf, m), len(names), len(ids))
            for q, asked in enumerate(wanted):
                own = best[q]
                found, scores = nra(lists, asked, k, own[k - 1][1] if len(own) >= k else 0)
                if len(found):
                    own += [(ids[d], s) for d, s in zip(found.tolist(), scores.tolist())]
                    own.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
                    del own[k:]
            for x in (ids, held, tfs, lengths):
                x.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, own, tf = _counts(number, text.as_py())
                if len(own):
                    for x, v in zip((ids, held, tfs, lengths), (doc, own, tf, n)):
                        x.append(v)
                if len(ids) >= block:
                    settle()
        if ids:
            settle()
        rows = [(q, *r) for q, own in enumerate(best) for r in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _passes(items: DataFrame) -> Iterator[Query]:
    rows = items.filter("text is not null")
    n = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Query(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of each item with a score above 0.

    Two scans of the documents, none of which shuffles them: one adds up the statistics of the asked
    terms, the other builds impact-sorted lists for `block` documents at a time and runs `nra` on them
    for each item. The k-th score a task has found so far is the bar of its later blocks. The tasks'
    best rows are cut to `k` twice, in salted groups and then for each item. Benchmark text beyond
    ITEM_CHARS takes further passes.

    Null and term-less texts match nothing and do not count as documents. Equal scores go by
    ascending doc_id, null ids last. Rows that repeat an id are documents of their own, repeated items
    are answered each. An empty table on either side gives no rows. Other columns are not read.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    out = None
    for query in _passes(asked):
        found = _searched(two, query, k, block)
        few = _best(found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT))), ["item", "salt"], k)
        last = _best(few.drop("rank"), ["item"], k)
        names = docs.sparkSession.createDataFrame(list(enumerate(query.rows)), "item long, item_id long")
        part = last.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.union(part)
    return out
