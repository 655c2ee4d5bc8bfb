import os
from pathlib import Path

import pytest

import corpus_pipeline
from rostrum.llm import decontaminate, secrets, simhash

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_each_stage_equals_its_brute_force_version(spark, tmp_path):
    import re

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append({r.doc_id: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect())
        assert name == "best_fit_packing" or docs.columns == COLUMNS
    quality, single, clean, masked, packed = tables
    source = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for i, r in quality.items():
        assert len(r.text.split()) > 0 and set(r.text.split("\n")) <= set(source[i].text.split("\n")) and r.n_chars == len(r.text)
    # Near copies: components of all pairs by the operator's own distance.
    radius = simhash.similarity_radius(0.8, 8)
    fps = {i: simhash.fingerprint(r.text, 5, 8) for i, r in quality.items()}
    ids, root = sorted(fps), {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    band = lambda n: int(np.floor(np.log(max(n, 1)) / -np.log(0.8)))
    for k, a in enumerate(ids):
        for b in ids[:k]:
            near = (int.from_bytes(fps[a][0]) ^ int.from_bytes(fps[b][0])).bit_count() <= radius
            if near and abs(band(fps[a][1]) - band(fps[b][1])) <= 1:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert set(single) == {i for i in ids if top(i) == i}
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    index = decontaminate.build([(r.item_id, r.text) for r in bench])
    assert set(clean) == {i for i, r in single.items() if not decontaminate._leaks(index, [r.text])}
    assert not any(b.text in r.text for b in bench for r in clean.values())
    assert set(masked) == set(clean)
    for i, r in masked.items():
        assert not re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r.text) and r.n_chars == len(r.text)
        assert secrets.MASK in r.text or r.text == clean[i].text
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {}
    for p in packed:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {i: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in masked.items()}


def test_empty_documents_pass_through(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of a benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_through(spark, tmp_path):
    prose = "A member of the committee asked the witness a long question about nothing in particular, and then waited for some answer in vain"
    rows = [(None, prose, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, prose, "en", "s", 1), (3, prose, "en", "s", 1), (4, "word " * 50_000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 3), (True, 0)]


def test_nothing_here_hides_import_errors():
    root = Path(corpus_pipeline.__file__).parent
    for path in [root / "corpus_pipeline.py", *(root / "rostrum/llm").glob("*.py")]:
        assert "ImportError" not in path.read_text() and "ModuleNotFoundError" not in path.read_text()
