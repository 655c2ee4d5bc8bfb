import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import toxicity

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.filter(~held))
    rows = toxicity.assess(docs.filter(held), model).withColumnRenamed("toxic", "guess").join(labels, "doc_id").collect()
    hit = sum(r.guess and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) >= 0.85
    assert hit / sum(r.guess for r in rows) >= 0.9
    assert np.mean([r.expected_severity for r in rows if r.toxic]) > 10 * np.mean([r.expected_severity for r in rows if not r.toxic])


def test_gradient_reaches_ordered_severity():
    rng = random.Random(1)
    sizes, col, counts, toxic = [], [], [], []
    for k in range(600):
        n = rng.choice([0, 0, 0, 1, 2, 5])
        words = Counter(rng.choice("abcdefgh") for _ in range(20))
        if n:
            words["vile"] = n
        sizes.append(len(words))
        col += ["abcdefgh".index(w) if w != "vile" else 8 for w in words]
        counts += words.values()
        toxic.append(int(n > 0))
    model = toxicity.fit(*(np.array(x) for x in (sizes, col, counts, toxic)), [*"abcdefgh", "vile"], np.array([0.1] * 8 + [9.0]))
    score = [model.score(Counter({b"vile": n} if n else {b"a": 1})) for n in (0, 1, 2, 5)]
    severity = model.over(np.array(score)).sum(axis=1)
    assert list(severity) == sorted(severity) and severity[0] < 0.5 < severity[1] and severity[3] > 2
    assert np.all(np.diff(model.cuts) > 0)


def test_edge_cases(spark):
    schema = "doc_id long, text string, toxic string"
    rows = [(i, "vile words " * 3 if i % 3 == 0 else "kind words here", "old") for i in range(60)] + [(None, "vile", ""), (100, None, ""), (101, "", ""), (102, "vile " * 100_000, "")]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] * 2 + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.assess(df, toxicity.train(df, labels)).collect()}
    assert len(got) == len(rows)
    assert got[3].toxic and got[102].toxic and got[None].toxic and not got[4].toxic
    assert not got[100].toxic and got[100].expected_severity == got[101].expected_severity
    none = toxicity.train(df, labels.filter("false"))
    assert not any(r.toxic for r in toxicity.assess(df, none).collect())
    assert toxicity.assess(df.filter("false"), none).count() == 0


def test_copies_of_a_labelled_id_count_once(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["calm", "plain", "table", "river", "stone", "paper"])
    rows = [(i, " ".join([word() for _ in range(30)] + (["vile", "scum"] * 4 if i % 4 == 0 else []))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    once = toxicity.train(docs, labels)
    again = toxicity.train(docs.union(docs.filter("doc_id < 8")).union(docs.filter("doc_id = 4")).repartition(3), labels)
    assert np.array_equal(once.cuts, again.cuts) and once.weights == again.weights
