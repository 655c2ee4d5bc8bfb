import pytest
from pyspark.sql import functions as F

from rostrum.plans import compose
from rostrum.sources import stage


@pytest.fixture
def sources(spark):
    df = spark.createDataFrame
    return compose.Sources(
        hearings=df([("h1", 115, "house", "T1"), ("h2", 116, "house", "T2")], "hearing_id string, congress int, chamber string, title string"),
        committees=df([("h1", "hsag00", "Ag")], "hearing_id string, committee_code string, committee_name string"),
        dates=df([("h1", "2017-05-01"), ("h2", "2019-06-01")], "hearing_id string, hearing_date string"),
        members=df([("S1", "Smith", "Ann", "Republican", "AK"), ("D1", "Doe", "Bob", "Democrat", "TX")], "bioguide_id string, last_name string, first_name string, party string, state string"),
        terms=df([("S1", 115, "house"), ("D1", 116, "house")], "bioguide_id string, congress int, chamber string"),
        hearing_members=df([("h1", "S1")], "hearing_id string, bioguide_id string"),
        ideology=df(
            [(115, "House", "S1", 0.4, 0.0, "AK", 1, "F"), (116, "House", "D1", -0.3, 0.0, "TX", 5, "M")],
            "congress int, chamber string, bioguide_id string, nominate_dim1 double, nominate_dim2 double, state_abbrev string, district_code int, gender string",
        ),
        leaders=df([(115, "HSAG", "chair", 0, "S1")], "congress int, thomas_id string, role string, ord int, bioguide_id string"),
        elections=df([(2016, "AK", "0", 60.0, 100.0)], "year int, state_po string, district string, candidatevotes double, totalvotes double"),
    )


def test_end_to_end(spark, sources, tmp_path):
    filler = "This is a long sentence about data and evidence. " * 3
    texts = spark.createDataFrame(
        [
            ("h1", f"    Mr. Smith. {filler}\n    The Chairman. Thank you all.\n    Dr. Who. I am a witness."),
            ("h2", f"    Ms. Doe. {filler}\n    Mr. Nobody. I am not known."),
            ("h3", "short"),
        ],
        "hearing_id string, raw_text string",
    )
    out = compose.run(texts, sources, str(tmp_path), sample_size=4)
    rows = {(r.hearing_id, r.speaker): r for r in out["enriched"].collect()}
    assert set(rows) == {("h1", "Mr. Smith"), ("h1", "The Chairman"), ("h2", "Ms. Doe")}
    smith, chair, doe = rows[("h1", "Mr. Smith")], rows[("h1", "The Chairman")], rows[("h2", "Ms. Doe")]
    assert (smith.match_type, chair.match_type, doe.match_type) == ("hearing_member_exact", "committee_chair_exact", "congress_exact")
    assert (smith.minority, doe.minority, smith.chairspeech, smith.vote_pct, str(smith.hearing_date)) == (0, 0, 1, 60.0, "2017-05-01")
    assert doe.committee_code is None and doe.vote_pct is None
    assert out["sample"].count() == 4
    assert out["sentences"].select("sentence_id").distinct().count() == out["sentences"].count()
    report = {(r["item"], r.value): r.n for r in out["report"].collect()}
    assert report[("match_type", "congress_exact")] == 3 and sum(n for (item, _), n in report.items() if item == "congress") == out["enriched"].count()


def test_sentences_are_reused_only_for_the_same_inputs(spark, sources, tmp_path):
    import os

    filler = "This is a long sentence about data and evidence. " * 3
    path = str(tmp_path / "texts")
    spark.createDataFrame([("h1", f"    Mr. Smith. {filler}"), ("h2", f"    Ms. Doe. {filler}")], "hearing_id string, raw_text string").write.parquet(path)
    texts, out = spark.read.parquet(path), str(tmp_path / "out")

    def files():
        return sorted(f for f in os.listdir(f"{out}/sentences") if f.startswith("part-"))

    assert compose.run(texts, sources, out, sample_size=4)["sample"].count() == 4
    first = files()
    assert compose.run(texts, sources, out, sample_size=2, seed=1)["sample"].count() == 2 and files() == first
    only = compose.run(texts, sources, out, congresses=[115], chamber="house")
    assert {r.hearing_id for r in only["enriched"].collect()} == {"h1"} and files() != first
    assert compose.run(texts.filter("hearing_id = 'h2'"), sources, out)["enriched"].select("hearing_id").distinct().count() == 1


def test_stage_is_rebuilt_when_older_than_its_input(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    stage.cached(spark, dst, lambda: spark.range(1))
    spark.range(5).write.parquet(src)
    import os
    import time

    future = time.time() + 60
    os.utime(src, (future, future))
    assert stage.cached(spark, dst, lambda: spark.range(3), newer_than=src).count() == 3
