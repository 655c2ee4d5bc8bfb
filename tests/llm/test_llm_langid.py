import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    pytest.importorskip("os").path.exists(DATA) or pytest.skip("test tables absent")
    docs = spark.read.parquet(DATA)
    prototypes = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    held = docs.filter(langid.held_out(F.col("doc_id")))
    rows = langid.identify(held, prototypes).join(held.select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases_and_brute_force(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog and the bird", "en", ""), (2, "der Hund und die Katze und der Vogel", "de", ""), (3, None, "en", ""), (4, "123 ... !", "de", ""), (5, "", None, ""), (6, "THE DOG", None, ""), (7, "unD " * 400_000, None, ""), (None, "the end", None, ""), (8, "𝐀 x", None, "")]
    df = spark.createDataFrame(rows, schema)
    prototypes = langid.train(df)
    got = {r.doc_id: r for r in langid.identify(df, prototypes).collect()}
    assert [got[k].lang_pred for k in (1, 2, 6, 7, None)] == ["en", "de", "en", "de", "en"]
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))

    def vector(text):
        line = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())
        space, total = langid.Space(), 0
        for a, b, c in zip(f" {line} ", f" {line} "[1:], f" {line} "[2:]):
            total = total + (np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))).astype(int)
        return total

    for lang, k in (("en", 0), ("de", 1)):
        assert np.array_equal(prototypes[lang], vector(rows[k][1]))
    own = vector(rows[5][1])
    cosine = own @ prototypes["en"] / np.linalg.norm(own) / np.linalg.norm(prototypes["en"])
    assert got[6].score == pytest.approx(cosine)


def test_nothing_learned_and_empty_table(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.train(spark.createDataFrame([], schema)) == {}
    out = langid.identify(spark.createDataFrame([(1, "abc", None)], schema), {}).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
