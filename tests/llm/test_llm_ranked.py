import math
import random
import re
from collections import Counter

import numpy as np

from rostrum.llm import ranked

SCHEMA = "doc_id long, text string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    counts = [(i, len(w), Counter(w)) for i, w in held]
    df = Counter(t for *_, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, n, c in counts:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = 0
            for t in set(words(text)):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "É", "x\u0085y", "中文", "A1"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(40)]  # copies tie
    return docs + [(None, "w1 w2"), (None, "w1 w2"), (3, "w1 w2"), (900, None), (901, ""), (902, "-.! ?"), (903, "w7 " * 30_000)]


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    docs = corpus(rng, 120)
    items = [(i, " ".join(rng.choice(["w1", "w2", "w9", "W30", "É", "é", "a1", "none", "x\u0085y"]) for _ in range(6))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "w1"), (52, "w1"), (None, "w5, W5; w6")]
    for k, block in ((10, 16), (3, 4_096), (200, 50)):
        got = ranked.search(
            spark.createDataFrame([(i, t, "own") for i, t in docs], SCHEMA).repartition(3),
            spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, rank string"), k, block)
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(docs, items, k), key=key)


def test_nra_settles_membership_ties_and_scores():
    rng = np.random.default_rng(3)
    for n_docs, n_terms, high in ((1, 1, 2), (30, 5, 3), (500, 12, 50), (2_000, 6, 1_000_000)):
        term, doc = np.nonzero(rng.random((n_terms, n_docs)) < 0.4)
        impact = rng.integers(0, high, len(term))
        lists = ranked.Lists(term, doc, impact, n_terms, n_docs)
        for wanted in (np.arange(n_terms), np.arange(0, n_terms, 2)):
            whole = np.zeros(n_docs, np.int64)
            use = np.isin(term, wanted)
            np.add.at(whole, doc[use], impact[use])
            for k in (1, 10, n_docs):
                for least in (0, int(whole.max())):
                    found, scores = ranked.nra(lists, wanted, k, least, 4)
                    assert np.array_equal(scores, whole[found]) and len(set(found.tolist())) == len(found)
                    bar = max(1, least, int(np.sort(whole)[-k]) if k <= n_docs else 1)
                    assert set(np.flatnonzero(whole >= bar)) <= set(found.tolist())


def test_reading_stops_before_the_lists_end():
    impact = np.arange(50_000, 0, -1)

    lists = ranked.Lists(np.zeros(50_000, np.int64), np.arange(50_000), impact, 1, 50_000)
    reads = []
    lists.doc = type("Read", (), {"__getitem__": lambda self, s: reads.append(s.stop) or np.arange(50_000)[s]})()
    found, scores = ranked.nra(lists, np.array([0]), 10)
    assert scores.max() == 50_000 and max(reads) < 200


def test_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_CHARS", 20)
    docs, items = [(i, f"w{i % 5} w{i % 3}") for i in range(30)], [(i, f"w{i} w{i + 1} and more") for i in range(6)]
    got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items, 10))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "w1")], "doc_id long, text string"), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0
