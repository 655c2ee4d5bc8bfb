import pytest
from pyspark.sql import functions as F

from rostrum.operators import members

MEMBERS = [("A000001", "Smith", "John", "Republican", "CA"), ("B000002", "Jones", "Mary", "Democratic", "NY")]
M = "bioguide_id string, last_name string, first_name string, party string, state string"


def test_lookups(spark):
    m = spark.createDataFrame(MEMBERS, M)
    terms = spark.createDataFrame(
        [("A000001", 115, "house"), ("B000002", 115, "senate"), ("B000002", 116, "house")], "bioguide_id string, congress int, chamber string"
    )
    got = {(r.last_name_upper, r.congress) for r in members.lookup_from_terms(m, terms).collect()}
    assert got == {("SMITH", 115), ("JONES", 116)}
    hm = spark.createDataFrame([(10, "A000001"), (10, "B000002"), (20, "A000001")], "hearing_id int, bioguide_id string")
    h = spark.createDataFrame([(10, 118), (20, 118)], "hearing_id int, congress int")
    assert members.lookup_from_hearings(hm, m, h).count() == 2


@pytest.mark.parametrize(
    "days,congress,want",
    [
        (["2005-10-06", "2017-02-07", "2017-05-15"], 115, "2017-02-07"),
        (["1995-01-01", "2005-06-15"], 115, "2005-06-15"),
        (["2010-01-01", "2012-06-15", "junk"], 112, "2012-06-15"),
    ],
)
def test_hearing_dates(spark, days, congress, want):
    d = spark.createDataFrame([("h1", x) for x in days], "hearing_id string, hearing_date string")
    h = spark.createDataFrame([("h1", congress)], "hearing_id string, congress int")
    assert str(members.resolve_hearing_dates(d, h).first().hearing_date) == want


def test_minority(spark):
    df = spark.createDataFrame(
        [("Republican", 115), ("Democratic", 115), ("Republican", 999), (None, 115), ("Democrat", 116), ("Independent", 115)], "party string, congress int"
    )
    assert [r[0] for r in df.select(members.minority(F.col("party"), F.col("congress"))).collect()] == [0, 1, None, None, 0, 1]


IDEO = "congress int, chamber string, bioguide_id string, nominate_dim1 double, nominate_dim2 double, state_abbrev string, district_code int, gender string"


def test_ideology_covariates(spark):
    rows = [(c, "House", "A", 0.35, 0.0, "AK", 1, "F") for c in (113, 114, 115)]
    rows += [(115, "House", "B", -0.5, 0.0, "TX", 7, "M"), (115, "House", "B", -0.5, 0.0, "TX", 7, "M")]
    rows += [(115, "House", "C", None, 0.0, "MT", 2, "M"), (115, "Senate", "D", 0.1, 0.0, "TX", 0, "M")]
    got = {r.bioguide_id: r for r in members.ideology_covariates(spark.createDataFrame(rows, IDEO), [115]).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"].seniority, got["A"].freshman, got["B"].freshman, got["A"].female, got["B"].female) == (3, 0, 1, 1, 0)
    assert (got["A"].district_code, got["B"].district_code, got["C"].district_code) == (0, 7, 2)
    assert (got["A"].abs_dwnom1_rs, got["B"].abs_dwnom1_rs, got["C"].abs_dwnom1_rs) == (0.5, 1.0, None)
    assert got["A"].seniority_rs == 1.0 and got["B"].seniority_rs == pytest.approx(0.5)


def test_winning_shares(spark):
    df = spark.createDataFrame(
        [(2016, "WY", "0", 10.0, 0.0), (2016, "NY", "14", 50.0, 60.0), (2016, "NY", "14", 10.0, 60.0), (2016, "TX", "5", 7.0, 7.0), (2016, "CA", "x", None, 9.0)],
        "year int, state_po string, district string, candidatevotes double, totalvotes double",
    )
    got = {(r.state_abbrev, r.district_code, r.congress): (round(r.vote_pct, 3), r.vote_imputed) for r in members.winning_shares(df).collect()}
    assert got == {("WY", 0, 115): (100.0, 1), ("NY", 14, 115): (83.333, 0), ("TX", 5, 115): (100.0, 0), ("CA", 0, 115): (100.0, 1)}


def test_leadership_flags(spark):
    leaders = spark.createDataFrame([(116, "HSAG", "chair", "C"), (116, "HSAG", "ranking_member", "R")], "congress int, thomas_id string, role string, bioguide_id string")
    df = spark.createDataFrame(
        [(1, "C", 116, "hsag00"), (2, "R", 116, "HSAG00"), (3, "C", 115, "hsag00"), (4, "C", 116, "hsag15"), (5, None, 116, "hsag00")],
        "i int, bioguide_id string, congress int, committee_code string",
    )
    got = [(r.chairspeech, r.rankmemspeech, r.leader) for r in members.leadership_flags(df, leaders).orderBy("i").collect()]
    assert got == [(1, 0, 1), (0, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_best_committee(spark):
    c = spark.createDataFrame([("h", "ssaa00", "Senate A"), ("h", "hsbb00", None), ("h", "hscc00", "House C")], "hearing_id string, committee_code string, committee_name string")
    h = spark.createDataFrame([("h", "house")], "hearing_id string, chamber string")
    assert members.best_committee(c, h, ["committee_code"]).first().committee_code == "hscc00"
