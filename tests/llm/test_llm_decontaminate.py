import random

import numpy as np

from rostrum.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id string"


def placed(window, text):
    """Fewest edits of `window` anywhere in `text`: the plain table, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("abcé") + text[k:], text[:k] + rng.choice("xyz") + text[k + 1 :]])
    return text


def case():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([8, 20, 30, 60, 3])] + [(7, None), (8, ""), (9, "short")]
    docs = [None, "", "short", "😀 é " * 50]
    for k in range(60):
        filler = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(2)]
        passage = rng.choice(items[:4])[1]
        if rng.random() < 0.3:
            cut = rng.randrange(len(passage))
            passage = passage[cut : cut + 160]
        passage = edited(rng, passage, rng.randrange(0, 12))
        docs.append(filler[0] + rng.choice([" ", "", "\n"]) + rng.choice([passage, passage.upper(), passage.replace(" ", " - ")]) + " " + filler[1])
    return items, docs


def test_found_windows_equal_brute_force():
    items, docs = case()
    index = d.build(items)
    got = {(r, name): n for r, name, n, *_ in d._leaks(index, docs)}
    want = {}
    for r, text in enumerate(docs):
        codes = d.folded(text or "")[0].tolist()
        for w, window in enumerate(index.windows):
            if codes and placed(window.tolist(), codes) <= index.budget[w]:
                key = (r, index.names[index.items[w]])
                want[key] = want.get(key, 0) + 1
    assert got == want and len(want) > 20


def test_chunks_and_blocks_change_nothing(spark, monkeypatch):
    items, docs = case()
    whole = d._leaks(d.build(items), docs)
    monkeypatch.setattr(d, "CHUNK_CHARS", 300)
    assert d._leaks(d.build(items), docs) == whole
    monkeypatch.setattr(d, "BLOCK_CHARS", 150)
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.windows_found, r.start, r.end) for r in d.find(df, bench).collect()}
    assert got == {(r, i, n, s, e) for r, i, n, _, _, s, e in whole}
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {r[0] for r in whole}


def test_cut_items_are_found_wherever_their_text_stands_in_a_chunk():
    rng = random.Random(31)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for size in (30, 60, 100):
        item = letters(size)
        index = d.build([(1, item)])
        for cut in range(int(index.budget[0]) + 2):
            for text in (item[cut:] + letters(50), letters(50) + item[: size - cut], item[cut:]):
                want = [(1, 1, 1, cut)] if cut <= index.budget[0] or placed(list(item), list(text)) <= index.budget[0] else []
                alone = d._leaks(index, [text])
                assert [r[1:5] for r in alone] == want
                late = d._leaks(index, [letters(150), text, letters(40)])
                assert [r[1:] for r in late] == [r[1:] for r in alone] and all(r[0] == 1 for r in late)


def test_quotes_of_a_window_are_found_at_every_offset():
    rng = random.Random(41)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    item = letters(260)
    index = d.build([(1, item), (2, letters(400))])
    texts = [letters(60) + item[at : at + 100] + letters(60) for at in range(161)]
    got = {r: (name, of, start, end) for r, name, _, of, _, start, end in d._leaks(index, texts)}
    assert sorted(got) == list(range(161))
    assert all(name == 1 and of == 161 and start <= 60 and end >= 160 for name, of, start, end in got.values())
    spoilt = [letters(60) + edited(rng, item[at : at + 100], 8) + letters(60) for at in range(161)]
    assert {r[0] for r in d._leaks(index, spoilt)} == set(range(161))


def test_spans_are_places_in_the_text():
    passage = "Whoever reads this passage, twice or more, will surely remember it for the rest of the day; they said so themselves yesterday."
    text = "é😀. " * 30 + passage + " -- end"
    ((_, item, found, of, edits, start, end),) = d._leaks(d.build([(5, passage)]), [text])
    assert (item, found, of, edits) == (5, 2, 2, 0) and text[start:end] == passage[:-1]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "some text", "x")], SCHEMA)
    assert d.find(docs, bench).count() == 0 and d.find(some, bench).count() == 0
    assert d.drop_contaminated(some, bench).count() == 1
    assert np.array_equal(d.grams(np.zeros(3, np.uint16)), np.zeros(0, np.uint64))


def test_repetitive_texts_take_bounded_time_and_memory():
    import time
    import tracemalloc

    rng = random.Random(5)
    for unit in ("0", "ha", "abcdefg"):
        item = (unit * 400)[:400]
        index = d.build([(1, item), (2, "".join(rng.choice("abcdefghij") for _ in range(150)))])
        short = [unit * (900 // len(unit)), "x" * 300, "lead " + unit * (500 // len(unit)) + " tail"]
        t = time.perf_counter()
        tracemalloc.start()
        got = d._leaks(index, ["some words first " + unit * (1_000_000 // len(unit)) + " and last", *short])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        took = time.perf_counter() - t
        assert took < 150 and peak < 2 << 30, (unit, took, peak)
        own = [r for r in got if r[0] == 0]
        assert len(own) == 1 and own[0][1:5] == (1, 301, 301, 0) and own[0][6] - own[0][5] >= 1_000_000 - 8
        assert {r[0] for r in got} == {0, 1, 3}


def test_stretches_find_what_one_go_finds(monkeypatch):
    rng = random.Random(9)
    unit = "".join(rng.choice("abc") for _ in range(12))
    text = "".join(unit if rng.random() < 0.9 else rng.choice("abc") * rng.randrange(1, 9) for _ in range(160))
    items = [(1, unit * 20), (2, text[500:750]), (3, unit[5:] + unit * 8 + "b" + unit * 4)]
    index = d.build(items)
    texts = [text, text[100:900], "nothing here " * 9, text[::-1]]
    want = d._leaks(index, texts)
    assert {r[1] for r in want} == {1, 2, 3}
    monkeypatch.setattr(d, "MOST_PAIRS", 1_000)
    monkeypatch.setattr(d, "ALIGNED", 500)
    assert d._leaks(index, texts) == want


def test_a_batch_is_looked_at_in_slices(spark):
    import pyarrow as pa

    class Docs:
        columns, schema, sparkSession = ["text", "n"], None, spark

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil their old copper kettles beside a frozen river " * 2
    docs = Docs()
    d.drop_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    texts = [None if k % 50 == 0 else passage if k % 7 == 0 else f"{k} " + "word " * 3_000 for k in range(200)] + ["x " * d.CHUNK_CHARS, ""]
    got = list(docs.run([pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)))], ["text", "n"])]))
    assert [n for b in got for n in b.column(1).to_pylist()] == [k for k, t in enumerate(texts) if t != passage]
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= d.CHUNK_CHARS for b in got)
