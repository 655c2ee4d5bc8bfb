import hashlib
import random
import zlib

import numpy as np

from rostrum.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaf = {k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)}
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below), len(leaf),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def trie(spark, rows):
    got = prefixes.prefix_trie(spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t in ("bigint", "string") for _, t in got.dtypes)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1]))


def many():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 215), -5, -250, 7_000_000_000_000]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é😀", "", None])))
    for c in range(300, 330):  # copies of one conversation
        rows += [(c, t, "user", f"turn {t}") for t in range(9)]
    return rows + [(None, 1, "user", "no id"), (0, 1, "user", "a"), (0, 1, "user", "a")]


def test_trie_equals_brute_force(spark):
    rows = many()
    assert trie(spark, rows) == brute(rows)


def test_long_conversations_are_products_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 7)
    rows = many() + [(c, t, "user", str(t % 3)) for c in (400, 401, 402) for t in range(60 + c % 2)]
    assert trie(spark, rows) == brute(rows)


def test_ends_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 9)
    rows = many()
    assert trie(spark, rows) == brute(rows)


def test_fingerprints_compose():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, prefixes.P, 500, dtype=np.uint64) for _ in range(2))
    assert prefixes.mulmod(a, b).tolist() == [x * y % prefixes.P for x, y in zip(a.tolist(), b.tolist())]
    edge = np.array([0, 1, prefixes.P - 1], np.uint64)
    assert prefixes.mulmod(edge, edge).tolist() == [0, 1, 1]
    for lane in (0, 1):
        want, seen = [], 0
        for i, t in enumerate(a.tolist()):
            seen = ((seen if i not in (0, 100, 101) else 0) * prefixes.BASES[lane] + t) % prefixes.P
            want.append(seen)
        start = np.repeat([0, 100, 101], [100, 1, 399])
        got = prefixes.running(lane, a, start)
        assert got.tolist() == want
        n = np.arange(500) - start + 1
        assert np.array_equal(prefixes.before_last(lane, got, a)[1:100], got[:99])
        joined = prefixes.product(lane, got[99:100], got[399:400], n[399:400])
        whole = prefixes.running(lane, np.concatenate([a[:100], a[101:400]]), np.zeros(399, np.int64))
        assert joined[0] == whole[-1]


def test_different_prefixes_under_one_fingerprint_are_noticed(spark):
    import pytest

    turns = prefixes.stored_turns(spark.createDataFrame([(1, 0, "user", "a", ""), (2, 0, "user", "b", "")], SCHEMA))
    members = spark.createDataFrame([(1, 1, 5, 5, 0, 0, 1, 0), (2, 1, 5, 5, 0, 0, 2, 0)], ", ".join(f"{c} long" for c in prefixes._MEMBER))
    node = "depth long, f1 long, f2 long, g1 long, g2 long, low struct<c:long,p:long>, high struct<c:long,p:long>, same_parent boolean"
    with pytest.raises(RuntimeError):
        prefixes._verified(members, spark.createDataFrame([(1, 5, 5, 0, 0, (1, 0), (2, 0), True)], node), turns)


def test_empty_table(spark):
    assert trie(spark, []) == []
