"""Rows that a join cannot need stay where they are."""

import random
import time

from pyspark.sql import functions as F

from rostrum.llm import simhash
from rostrum.operators import matching, members
from rostrum.operators import relational as rel
from rostrum.session import cut_lineage
from rostrum.streaming import ingest


def shuffled_rows(df):
    """Runs `df` and returns its rows and how many rows its exchanges wrote, those below broadcasts included."""
    rows = df.collect()
    todo, moved = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            moved += node.metrics().get("shuffleRecordsWritten").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, moved


def test_listed_keys_pass_and_few_others(spark):
    df = spark.range(20_000).select(F.when(F.col("id") != 7, F.col("id")).alias("a"), F.concat(F.lit("k"), "id").alias("b"))
    listed = df.filter("a is null or a % 40 = 3").repartition(3)
    for n in (500, 1, 100_000):  # a wrong number lets other rows pass, but loses none
        marked, perhaps = rel.perhaps_listed(df, listed, ["a", "b"], n)
        got = marked.select("a", perhaps.alias("p")).collect()
        assert len(got) == 20_000 and all(r.p is not None for r in got)
        assert all(r.p for r in got if r.a is None or r.a % 40 == 3)
        assert n == 1 or sum(r.p for r in got) < 1_500
    marked, perhaps = rel.perhaps_listed(df, listed.limit(0), ["a", "b"], 0)
    assert marked.filter(perhaps).count() == 0


def test_seen_keys_that_a_batch_does_not_hold_do_not_move(spark):
    rng = random.Random(5)
    bucket = F.pmod(F.xxhash64("k"), F.lit(4)).cast("int")
    for kind in ("long", "string"):
        seen = spark.range(40_000).select((F.col("id") * 3).cast(kind).alias("k")).withColumn("bucket", bucket)
        asked = [rng.randrange(120_000) for _ in range(300)]
        batch = spark.createDataFrame([(a, "v") for a in dict.fromkeys([*asked, None])], "k long, v string").select(F.col("k").cast(kind), "v")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            rows, moved = shuffled_rows(ingest.unseen(batch, batch.select("k"), seen, ["k"], bucket))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(str(r.k) for r in rows) == sorted(str(a) for a in {*asked, None} if a is None or a % 3)
        assert moved < 5_000


def test_texts_that_stay_are_not_moved_for_the_list_of_dropped_ones(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(60))
    texts = [text() for _ in range(600)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1_000 + i, texts[i], "y") for i in range(30)] + [(5, texts[5], "x"), (None, texts[9], "z"), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _word string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, moved = shuffled_rows(simhash.drop_near_duplicates(df.localCheckpoint()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r}, _word={w!r})" for i, t, w in {r for r in rows if r[0] is None or r[0] < 1_000})
    assert moved < 300


def test_hearings_make_only_asked_names(spark):
    """Fifty members share an id; before, each hearing took a row of every one of them to the count of its names."""
    people = spark.createDataFrame([("B1", f"Name{i % 40}") for i in range(50)] + [("B2", "Lee"), ("B3", "Lee"), ("B4", None), (None, "Ray")], "bioguide_id string, last_name string")
    people = people.selectExpr("*", "'X' as first_name", "'P' as party", "'S' as state")
    seen = spark.createDataFrame([(h, b) for h in range(30) for b in ("B1", "B2", "B4", None)] + [(1, "B3"), (2, "B2"), (None, "B2")], "hearing_id int, bioguide_id string")
    pairs = spark.createDataFrame(
        [(h, n, n.split(" ")[-1], 105, None) for h in range(30) for n in ("NAME3", "ANN NAME30", "LEE", "RAY")] + [(3, None, None, 105, None), (None, "LEE", "LEE", 105, None)],
        "hearing_id int, speaker_last_name string, speaker_last_word string, congress int, committee_code string",
    )
    asked = matching.asked_names(pairs)
    whole, few = members.hearing_member_map(seen, people), members.hearing_member_map(seen, people, asked)
    assert few.groupBy().sum("_n").first()[0] < whole.count() / 3
    want = matching.unambiguous(whole, "hearing_id").withColumnRenamed("last_name_upper", "name").join(asked.distinct(), ["hearing_id", "name"], "left_semi")
    got = matching.unambiguous(few, "hearing_id").withColumnRenamed("last_name_upper", "name").join(asked.distinct(), ["hearing_id", "name"], "left_semi")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 58
    both = [sorted(map(str, matching.in_hearing(pairs, m).collect())) for m in (whole, few)]
    assert both[0] == both[1] and sum("B2" in r for r in both[0]) == 28


def test_matches_are_written_back_where_sentences_lie(spark):
    rng = random.Random(3)
    pick = lambda xs: rng.choice(xs)
    names = [f"N{i}" for i in range(40)] + [None]
    said = [(pick([1, 2, 3, None]), i, pick(names), pick(["a", "b", None]), pick([105, 106, None])) for i in range(2000)]
    pairs = [(pick([1, 2, 3, 4, None]), pick(names), pick(["a", "b", None]), pick([105, 106, None]), f"B{i}") for i in range(300)]
    sentences = spark.createDataFrame(said, "hearing_id int, i int, speaker_last_name string, committee_code string, congress int")
    sentences = sentences.join(spark.createDataFrame([(1, "x"), (2, "y")], "hearing_id int, title string"), "hearing_id", "left")
    matched = spark.createDataFrame(pairs, "hearing_id int, speaker_last_name string, committee_code string, congress int, bioguide_id string")
    for nullable in (["committee_code"], ["committee_code", "congress"]):
        right = matched.drop(*{"congress"} - {*nullable})
        want = rel.null_safe_join(sentences, right, ["hearing_id", "speaker_last_name"], nullable)
        got = matching.written_back(sentences, right, nullable)
        assert got.columns == want.columns
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            (a, moved), (b, before) = shuffled_rows(got), shuffled_rows(want)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) > 2000
        assert moved < 2400 < 4000 < before  # the sentences have moved once, to the titles of their hearings


def test_facts_follow_the_sentences_congress(spark):
    """A hearing that is listed under two congresses: every match meets the sentence's congress, as a join after the write-back has it."""
    schema = "hearing_id string, speaker_last_name string, speaker_last_word string, congress int, committee_code string"
    sentences = spark.createDataFrame([("h", "LEE", "LEE", 105, None), ("h", "LEE", "LEE", 106, None), ("h", "NONE", "NONE", 106, None), ("g", "LEE", "LEE", None, "x")], schema)
    look = spark.createDataFrame([("L1", 105, "LEE", "Ann"), ("L2", 106, "LEE", "Bob")], "bioguide_id string, congress int, last_name_upper string, first_name string")
    people = spark.createDataFrame([("L1", "Lee", "Ann", "P", "S"), ("L2", "Lee", "Bob", "P", "S")], "bioguide_id string, last_name string, first_name string, party string, state string")
    seen = spark.createDataFrame([("g", "L1")], "hearing_id string, bioguide_id string")
    leaders = spark.createDataFrame([], "congress int, thomas_id string, role string, ord int, bioguide_id string")
    facts = spark.createDataFrame([("L1", 105, 0.1), ("L1", 106, 0.2), ("L2", 105, 0.3)], "bioguide_id string, congress int, score double")
    args = (sentences, members.hearing_member_map(seen, people), look, leaders, people)
    want = matching.match_speakers(*args).join(facts, ["bioguide_id", "congress"], "left")
    got = matching.match_speakers(*args, facts=facts).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 6
    assert sorted(r.score for r in got.collect() if r.score) == [0.1, 0.2, 0.3]


def test_large_cuts_return_their_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before = files()
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), large=True)
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and kept.count() == 7
