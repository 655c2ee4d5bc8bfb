import random

import numpy as np
import xxhash

from rostrum.llm import graph, simhash

SCHEMA = "doc_id long, text string, FP string"


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, near):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"wörd{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, "A b c d"), (8, "x" * 200_000)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), rng.choice([" ", "\n", " \r\n\x0b"]).join(text)))
    return rows


def test_result_equals_brute_force(spark):
    rows = corpus()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = brute_components(list(fps), near)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[:20]], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 20
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d", ""), (5, "a b c d", ""), (3, "a b c d", "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, None), (3, 3), (5, 3)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 97}\n" for i in range(3_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 64)
    assert simhash.fingerprint(text) == whole


def test_tile_links_connect_what_brute_force_connects(monkeypatch):
    monkeypatch.setattr(simhash, "INNER", 16)
    rng = np.random.default_rng(1)
    for words, radius in ((1, 2), (8, 77)):
        base = rng.integers(0, 1 << 63, (20, words), dtype=np.uint64)
        x = np.repeat(base, 6, axis=0)
        for r in x:
            for _ in range(rng.integers(0, radius + 2)):
                r[rng.integers(words)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        n = len(x)
        near = [(i, j) for i in range(n) for j in range(i) if np.bitwise_count(x[i] ^ x[j]).sum() <= radius]
        fps, ids = [r.tobytes() for r in x], np.arange(n)
        half = n // 2
        parts = [(fps[:half], ids[:half], None, None), (fps[half:], ids[half:], None, None), (fps[:half], ids[:half], fps[half:], ids[half:])]
        links = [(int(a), int(b)) for p in parts for a, b in zip(*simhash.tile_links(*p, radius))]
        assert brute_components(range(n), links) == brute_components(range(n), near)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(i, 500 + (i + 1 - 500) % 30) for i in range(500, 530)] + [(9, 9), (None, 4), (7, 200)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(edges)
    nodes = {n for e in edges for n in e if n is not None and e[0] != e[1] and None not in e}
    want = brute_components(nodes, [e for e in edges if None not in e and e[0] != e[1]])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(300)]
    near, far = list(base), [w + "z" for w in base]
    near[10] = "changed"
    rows = [(4, " ".join(base), "en"), (2, " ".join(near), "en"), (2, " ".join(near), "en"), (9, " ".join(far), "en"), (None, " ".join(base), None)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert out.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 9]


def test_rows_that_share_an_id_keep_texts_that_have_no_copy(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(120))
    a, b, c = text(), text(), text()
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (5, c, "x"), (5, c, "x"), (6, c, "x"), (5, None, "x"), (8, None, "x"), (8, "", "x"), (5, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == ["doc_id", "text", "_row"]
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got == sorted([(3, a), (5, b), (5, c), (5, " ")])
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df.filter("text is not null")).collect()}
    print_of = lambda t: simhash.fingerprint(t)[0].hex()
    assert found[7, print_of(b)] == 5 and found[5, print_of(a)] == 3 and found[6, print_of(c)] == 5
