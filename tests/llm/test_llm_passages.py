import hashlib
import random

import numpy as np
import pytest

from rostrum.llm import passages

SCHEMA = "doc_id long, text string, k string, n_words string"


def brute(rows, window=50):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for s in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[s : s + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if i is not None and least[tuple(words[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    prose = lambda n: [rng.choice("abcdefgh") * rng.randrange(1, 5) + rng.choice(["", "é", ",", "中"]) for _ in range(n)]
    shared = [prose(n) for n in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(60):
        words = prose(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 30)
            words += s[cut:] + prose(rng.randrange(0, 40))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    base = prose(400)
    for i in range(60, 80):  # near copies: each with words of its own
        copy = list(base)
        for _ in range(i - 60):
            copy[rng.randrange(len(copy))] = f"own{rng.random()}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, rows[62][1]) for i in range(40)]  # copies
    rows += [(200, "ha " * 300), (201, "ha " * 90), (202, "ha he " * 120), (203, "he ha " * 60), (204, "x" * 100_000 + " " + " ".join(base[:60]))]
    rows += [(300, " ".join(shared[4])), (300, " ".join(shared[4])), (300, " ".join(base)), (None, " ".join(base)), (None, None), (301, None), (302, ""), (303, " \n\x0b"), (304, " ".join(shared[4]) + " end")]
    return rows


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("limits", [{}, {"SEGMENT_BITS": 12, "HELD": 20, "CHUNK": 3_000}, {"SLICE": 64, "CHUNK": 500}])
def test_removal_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(passages, name, value)
    monkeypatch.setattr(passages, "_KEPT", {})
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], SCHEMA).repartition(5)
    got = passages.remove_repeats(docs, with_text=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("bits", [3, 5, -60])
def test_a_full_sketch_or_none_loses_nothing(spark, monkeypatch, bits):
    real = np.clip
    monkeypatch.setattr(passages.np, "clip", lambda x, lo, hi: real(x, min(lo, abs(bits)), abs(bits)))
    rows = corpus(8)
    if bits < 0:  # texts beyond the sketch are counted by a shuffle
        monkeypatch.setattr(passages, "CELLS_PER_BYTE", 1e12)
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], SCHEMA)
    got = passages.remove_repeats(docs)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((r[:4] for r in brute(rows)), key=key)


def test_sketch_counts_no_less_than_documents():
    texts = [t.encode() for i, t in corpus() if t and i is not None]
    chunk = passages.Chunk(texts)
    words = [t.split() for t in texts]
    held = {}
    for t, b, n, a in zip(chunk.text, chunk.begin - chunk.first_word[chunk.text], chunk.n, chunk.anchor):
        for s in range(b, b + n):
            held.setdefault(tuple(words[t][s : s + 50]), []).append((int(t), int(a)))
    assert sum(len(v) for v in held.values()) == sum(max(0, len(w) - 49) for w in words)
    assert all(len({a for _, a in v}) == 1 for v in held.values())


def test_words_are_hashed_alike_wherever_they_stand():
    text = ("été " + "y" * 2_000_000 + " z\n" + "été z ").encode()
    begin, hashes = passages.word_hashes(np.frombuffer(text, np.uint8), (0, 1))
    assert begin.tolist() == [0, 6, 2_000_007, 2_000_009, 2_000_015]
    for h in hashes:
        assert h[0] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 3


def test_empty_table(spark):
    assert passages.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
