from pyspark.sql import functions as F

from rostrum.functions import names, text
from rostrum.operators import transcripts


def chunks(spark, raw):
    df = spark.createDataFrame([("h", raw)], "hearing_id string, raw_text string")
    return [(r.speaker, r.text) for r in transcripts.segment(df).orderBy("chunk_pos").collect()]


def test_segment_basic(spark):
    raw = "    Mr. SMITH. Thank you for having me.\nThis is a test.\n    Mrs. JONES. I agree."
    assert chunks(spark, raw) == [("Mr. SMITH", "Thank you for having me. This is a test."), ("Mrs. JONES", "I agree.")]


def test_segment_chairs_keep_case(spark):
    raw = "    The CHAIRMAN. We will begin.\n    The Chairwoman. Please sit down."
    assert chunks(spark, raw) == [("The CHAIRMAN", "We will begin."), ("The Chairwoman", "Please sit down.")]


def test_segment_skips_contents_and_blank_lines(spark):
    raw = "    Mr. SMITH. One.\n\nTable of contents .... 5\n\t\n  two.\r\n    Ms. DOE. Three."
    assert chunks(spark, raw) == [("Mr. SMITH", "One. two."), ("Ms. DOE", "Three.")]


def test_segment_multi_word_and_silent_speakers(spark):
    raw = "lost words\n    Representative De La Cruz. Thank you, Mr. Chairman.\n    Mr. MUTE.\n    Dr. O'Neil-Day. Yes."
    assert chunks(spark, raw) == [("Representative De La Cruz", "Thank you, Mr. Chairman."), ("Dr. O'Neil-Day", "Yes.")]


def test_segment_empty(spark):
    assert chunks(spark, "") == [] and chunks(spark, None) == []


def test_carried_speakers_equal_segmentation(spark):
    raw = "x\n    Mr. SMITH. One.\ntwo\n\nA .... 3\nthree\n    Mrs. JONES. Four.\nfive\n    Mr. MUTE.\n    The Chairman. Six."
    lines = [("h", i, s) for i, s in enumerate(raw.split("\n"))]
    df = spark.createDataFrame(lines, "hearing_id string, pos long, line string")
    for span in (1, 2, 100):
        rows = transcripts.carry_speaker(df, ["hearing_id"], "pos", "line", span=span).orderBy("pos").collect()
        got = {}
        for r in rows:
            got.setdefault((r.chunk_id, r.speaker), []).append(r.said)
        assert [(s, " ".join(t)) for (_, s), t in got.items()] == chunks(spark, raw)


def test_context_windows_and_short_sentences(spark):
    df = spark.createDataFrame([("h", "    Mr. A. B.")], "hearing_id string, raw_text string")
    assert transcripts.segment(df).count() == 0
    df = spark.createDataFrame([("h", "    Mr. Smith. Sentence one. Ok. Sentence three.")], "hearing_id string, raw_text string")
    rows = transcripts.sentence_records(df).orderBy("sent_pos").collect()
    assert [(r.context_before, r.sentence, r.context_after) for r in rows] == [("", "Sentence one.", "Ok."), ("Ok.", "Sentence three.", "")]
    assert rows[0].speaker_last_name == "SMITH"


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([("Mr. J. B. Doe spoke. The U.S. team won! No. 5 is it? Yes.",)], "t string")
    got = df.select(text.sentences(F.col("t")).alias("s")).first().s
    assert got == ["Mr. J. B. Doe spoke.", "The U.S. team won!", "No. 5 is it?", "Yes."]


def test_name_parts(spark):
    cases = {
        "Mr. SMITH": ("SMITH", "SMITH"),
        "Ms. Jackson Lee": ("JACKSON LEE", "LEE"),
        "Mr. Van Orden": ("VAN ORDEN", "ORDEN"),
        "The Chairman": ("CHAIRMAN", "CHAIRMAN"),
        "Chairman SMITH": ("SMITH", "SMITH"),
        "": (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "speaker string")
    got = {r.speaker: (r.speaker_last_name, r.speaker_last_word) for r in names.with_name_parts(df).collect()}
    assert got == cases


def test_witnesses(spark):
    people = ["Mr. Smith", "Senator Jones", "The Chairman", "Dr. Fauci", "General Milley", "John Doe", "The CHAIRMAN", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(people)], "i int, s string")
    got = [r.w for r in df.select("i", text.is_witness(F.col("s")).alias("w")).orderBy("i").collect()]
    assert got == [False, False, False, True, True, True, True, True]
    loose = [r.w for r in df.select("i", text.is_witness(F.col("s"), True).alias("w")).orderBy("i").collect()]
    assert loose[6] is False


def test_keywords(spark):
    df = spark.createDataFrame([("This has data and evidence.",), ("This is factual.",), ("A fact based claim, 5%.",), (None,)], "t string")
    pick = lambda c: [r[0] for r in df.select(c).collect()]
    assert pick(text.has_keyword(F.col("t"), ["data", "fact"])) == [True, False, True, False]
    assert pick(text.has_keyword(F.col("t"), ["fact"], False)) == [False, True, True, False]
    assert pick(text.has_keyword(F.col("t"), ["%"])) == [False, False, True, False]
    assert pick(text.has_keyword(F.col("t"), [])) == [False] * 4
    assert text.parse_keywords(" Data, ,fact ") == ["data", "fact"]


def test_highlight_longest_first(spark):
    df = spark.createDataFrame([("Data and database",)], "t string")
    assert df.select(text.highlight(F.col("t"), "data database")).first()[0] == "<mark>Data</mark> and <mark>database</mark>"
    assert df.select(text.highlight(F.col("t"), "data", whole_words=True)).first()[0] == "<mark>Data</mark> and database"


def test_token_chunks(spark):
    df = spark.createDataFrame([(1, "a b  c\nd e"), (2, " ")], "id int, text string")
    got = [(r.id, r.n_tokens, r.chunk_no, r.chunk) for r in transcripts.token_chunks(df, 2).collect()]
    assert got == [(1, 5, 0, "a b"), (1, 5, 1, "c d"), (1, 5, 2, "e")]


def test_committee_code(spark):
    codes = {"hsag00": "HSAG", "HsAg00": "HSAG", "hsag15": "", "hs": "", None: "", "12345": ""}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.p for r in df.select("c", names.parent_committee(F.col("c")).alias("p")).collect()} == codes


def test_numbers_and_speakers_of_very_long_turns(spark):
    from types import SimpleNamespace

    from rostrum.plans import q_text

    rows = [(1, 1, 0, 0), (1, 0, 70_000, 0), (1, 0, 70_000, 2**24), (1, 0, 70_001, 0), (1, 0, 2**18, 5), (1, 2, 0, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, chunk_pos int, sent_pos int")
    got = q_text.number_sentences(df).orderBy("sentence_id").collect()
    assert [tuple(r)[:4] for r in got] == sorted(rows) and [r.sentence_id for r in got] == list(range(1, 7))
    turns = [(1, 0, "user", "first" + "\n" * (2**20 + 5) + "last"), (1, 1, "system", "second"), (1, 2, "assistant", "third")]
    t = SimpleNamespace(conversations=spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    said = {r.said: (r.chunk_id, r.speaker) for r in q_text.carry_speaker(t).collect()}
    assert said == {"first": (1, "Mr. Smith"), "last": (1, "Mr. Smith"), "second": (2, "The Chairman"), "third": (2, "The Chairman")}
