"""Steps that have to stay cheap at size: what they give on odd rows and how they are run."""

import re

from pyspark.sql import functions as F

from rostrum.functions import names, text
from rostrum.operators import dictionaries, matching, models, ranking


def test_name_parts_of_odd_speakers(spark):
    said = ["..a. .b.. c.d", " \t The  Chairman.", "MR. THE", "...", "mr mr x", "a\nb.\n", "\u0085x. ", None]
    df = spark.createDataFrame(list(enumerate(said)), "i int, speaker string")
    named = names.with_name_parts(df)
    got = [(r.speaker_last_name, r.speaker_last_word) for r in named.orderBy("i").collect()]
    assert got == [("A B C.D", "C.D"), ("CHAIRMAN", "CHAIRMAN"), ("THE", "THE"), (None, None), ("X", "X"), ("A B", "B"), ("X", "X"), (None, None)]
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1  # six before


def test_namesakes_take_one_row(spark):
    rows = [("B1", 105, "LEE", "Ann"), ("B2", 105, "LEE", "Ann"), ("B3", 105, "LEE", "Bob"), ("B4", 105, "RAY", None), ("B5", 105, None, "Cyd")]
    look = spark.createDataFrame(rows, "bioguide_id string, congress int, last_name_upper string, first_name string")
    short = matching.by_full_name(look)
    assert short.filter("last_name_upper = 'LEE'").count() == 2
    names_open = spark.createDataFrame([(105, "ANN LEE", "LEE"), (105, "BOB LEE", "LEE"), (105, "RAY", "RAY"), (105, "RAYS", "RAYS")], "congress int, speaker_last_name string, speaker_last_word string")
    for step in (matching.disambiguated, lambda o, l: matching.similar_names(o, l, 80.0)):
        assert sorted(map(str, step(names_open, short).collect())) == sorted(map(str, step(names_open, look).collect()))
    assert sorted(matching.unambiguous(short, "congress").collect()) == sorted(matching.unambiguous(look, "congress").collect())
    told = {r.speaker_last_name: r.hit.bioguide_id for r in matching.disambiguated(names_open, short).collect()}
    assert told == {"BOB LEE": "B3", "RAY": "B4"}


def test_match_report_counts_once(spark):
    got = matching.match_report(spark.createDataFrame([("fuzzy",), (None,), (None,), ("exact",)], "match_type string"))
    assert got.inputFiles()  # the counts are written; before, the rows were counted for the share again
    assert {(r.match_type, r.n, r.share) for r in got.collect()} == {("fuzzy", 1, 0.25), ("unmatched", 2, 0.5), ("exact", 1, 0.25)}


def test_keywords_look_once_at_a_place(spark):
    words = ["data", "peer-reviewed", "%", "study", "increase", "w"]
    texts = ["the DATA.", "databases", "5% off", "xpeer-reviewed", "peer-reviewed!", "ſtudy", "édata", "", None, "inc rease", "a W b"]
    plain = "(?iuU)" + "|".join(text.bounded(w) for w in words)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.has_keyword(F.col("t"), words).alias("a"), F.coalesce(F.col("t").rlike(plain), F.lit(False)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert text._any_of(words).count(r"(?<!\w)") == 1


def test_modes_are_counted_by_hash(spark):
    rows = [("a", 3), ("a", -7), ("a", -7), ("a", 3), ("b", None), ("c", 2**62), ("c", -(2**63)), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    for parts in (None, 3):
        m = ranking.modal_value(df, ["k"], "v", "m", parts)
        assert {(r.k, r.m) for r in m.collect()} == {("a", -7), ("c", -(2**63)), (None, 1)}
        assert "SortAggregate" not in m._jdf.queryExecution().executedPlan().toString()
    s = ranking.modal_value(df.select("k", F.col("v").cast("string").alias("v")), ["k"], "v", "m")
    assert {(r.k, r.m) for r in s.collect()} == {("a", "-7"), ("c", str(-(2**63))), (None, "1")}


def test_event_study_writes_its_columns_once(spark, monkeypatch):
    seen = []
    real = models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: (seen.append(df.columns), real(df))[1])
    rows = [(float((m * 7 + y * 3) % 11), 1997 + y, m % 2, m, "x") for m in range(12) for y in range(3)]
    df = spark.createDataFrame(rows, "y double, yr int, dem int, member int, other string")
    models.event_study(df, "y", "yr", "dem", 1998, ["member", "yr"])
    assert seen[0] == ["y", "yr", "dem", "member"]


def test_words_are_counted_without_a_split(spark):
    df = spark.createDataFrame([("a", "One-two  three!"), ("b", " "), ("c", None), ("d", "?")], "k string, text string")
    counts = dictionaries.term_counts(df, ["k"], "text", ["two"])
    assert {(r.k, r.n) for r in counts.filter("term is null").collect()} == {("a", 3), ("b", 1), ("c", 0), ("d", 1)}
    assert not re.search(r"size\(split", counts._jdf.queryExecution().optimizedPlan().toString())
