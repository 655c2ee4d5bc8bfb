import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from rostrum.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string"


def texts():
    rng = random.Random(6)
    yield from (None, "", " ", "\n", "a", " lead", "trail ", "two  blanks", "line\nline", "line \n line", "tab\tin", " nbsp x ", "it's we'll I'D", "<|endoftext|> in text", "a\0b c", "😀 é 中文 x1 22,3.", "\n\nx", "x\n\n")
    yield "w" * 30_000
    for _ in range(60):
        yield "".join(rng.choice(["Ab", "cé", "12", "'s", ",", ".", "😀"]) + rng.choice(["", " ", "\n", " ", "  ", "\t"]) for _ in range(rng.randrange(1, 3_000)))


def test_ids_are_those_of_the_tokenizer():
    plain, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for t in texts():
        assert np.frombuffer(own.ids(t or ""), "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]


def test_remembered_segments_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    plain, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    text = " ".join(f"w{i}" for i in range(400))
    assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(own) <= 50 and len(own.older) <= 50


def test_packing_is_whole_gapless_and_tight(spark):
    plain = Tokenizer.from_file(PATH)
    rows = [(i, t, "own") for i, t in enumerate(texts())]
    rows += rows[:5] + [(None, "no id", "own")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 3


def test_each_item_goes_where_the_sum_of_squares_is_smallest():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 31, 300)
    bins, offsets = packing.sum_of_squares(lengths, 30)
    gaps = {}
    for size, b, offset in zip(lengths, bins, offsets):
        n = np.bincount([g for g in gaps.values() if g], minlength=31)

        def after(gap):
            m = n.copy()
            if gap < 30:
                m[gap] -= 1
            if gap > size:
                m[gap - size] += 1
            return int((m**2).sum())

        options = {after(g) for g in {30, *gaps.values()} if g >= size}
        chosen = gaps.get(b, 30)
        assert after(chosen) == min(options) and offset == 30 - chosen
        gaps[b] = chosen - size


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_white_space_of_any_kind_is_cut_where_the_tokenizer_cuts():
    plain, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    rng = random.Random(9)
    spaces = [" ", "  ", "   ", "\n", "\n\n", "\n ", " \n", "\t", "\t\t ", "\r\n", " \r\n\r\n  ", "\x0b", "\x0c "]
    odd = [" ", "  ", "　 ", "\x1c", "\u0085"]
    texts = ["".join(rng.choice(["ab", "Zé", "1", "'ll", "?!", "中文", "x"]) + rng.choice(spaces + (odd if k % 4 == 0 else [])) for _ in range(rng.randrange(0, 200))) for k in range(80)]
    texts += [rng.choice(spaces) + t for t in texts[:40]] + ["", *spaces, *odd]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)[:80]
    ids, counts = own.encode(pa.array(texts))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_remembered_bytes_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 20_000)
    plain, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    text = " ".join([f"word{i}" * (i % 7) for i in range(500)] + ["q" * 9_000])
    assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert own.size <= 20_000 and sum(len(k) + len(v) for k, v in own.older.items()) <= 20_000


def test_letters_and_the_marks_behind_them_are_remembered_apart():
    plain, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    words, marks = ["Ab", "cé", "ñandú", "x×", "don", "ÿ", "ɏ", "中"], [".", ",", "!?", "'t", "'", "'s.", "1", "$$$", "(a)", "-b", "…", "é"]
    text = " " + " ".join(w + m + more for w in words for m in marks for more in ("", ".", "'ll"))
    assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    own = packing.Encoder(PATH)
    own.ids(" one" + "".join(f" one{m}" for m in (".", ",", ";", ":", "!", "?")) + " né né. né,")
    assert sorted(own) == sorted([b" one", " né".encode(), *(m.encode() for m in ".,;:!?")])


def test_a_worker_remembers_no_more_than_a_hundred_megabytes():
    import sys

    own = packing.Encoder(PATH)
    for k in range(1_200_000):
        own._remember(b" w%d" % k, b"12345678")
    held = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + 41 for k in d) for d in ({**own}, own.older))
    assert held < 100e6
