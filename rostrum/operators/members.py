"""Member lookups, hearing metadata and political covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, names
from . import ranking
from . import relational as rel

# House majority and unified government per congress.
HOUSE_MAJORITY = {115: "Republican", 116: "Democratic", 117: "Democratic", 118: "Republican", 119: "Republican"}
UNIFIED_GOVERNMENT = {115: 1, 116: 0, 117: 1, 118: 0, 119: 1}
# States with a single at-large district.
AT_LARGE_STATES = ("AK", "DE", "MT", "ND", "SD", "VT", "WY")
MEMBER_COLS = ["bioguide_id", "last_name", "first_name", "party", "state"]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# ---- hearing metadata --------------------------------------------------------------


def resolve_hearing_dates(hearing_dates: DataFrame, hearings: DataFrame, known: tuple[int, int] = (115, 119)) -> DataFrame:
    """One date per hearing: the first inside its congress, else the latest that can be read.

    Congresses outside `known` have no session range and use the latest date.
    """
    d = hearing_dates.select("hearing_id", dates.parse_date(F.col("hearing_date")).cast("date").alias("_d"))
    d = d.join(hearings.select("hearing_id", "congress"), "hearing_id", "left")
    inside = F.col("congress").between(*known) & dates.in_session(F.col("_d"), F.col("congress"))
    return d.groupBy("hearing_id").agg(
        F.coalesce(F.min(F.when(inside, F.col("_d"))), F.max("_d")).alias("hearing_date")
    )


def best_committee(committees: DataFrame, hearings: DataFrame, order: list[str]) -> DataFrame:
    """One committee per hearing: chamber-matching code first, then a named one, then `order`."""
    c = committees.join(hearings.select("hearing_id", "chamber"), "hearing_id", "left")
    code = F.col("committee_code")
    fits = ((F.col("chamber") == "house") & code.startswith("hs")) | ((F.col("chamber") == "senate") & code.startswith("ss"))
    c = c.withColumn("_fit", -F.coalesce(fits, F.lit(False)).cast("int")).withColumn(
        "_named", -F.col("committee_name").isNotNull().cast("int")
    )
    # The order goes first in one struct, so a row moves with each of its values once.
    told = list(dict.fromkeys(["_fit", "_named", *order, "committee_code", "committee_name"]))
    best = c.groupBy("hearing_id").agg(F.min(F.struct(*told)).alias("_r"))
    return best.select("hearing_id", "_r.committee_code", "_r.committee_name")


# ---- member lookups ------------------------------------------------------------------


def with_name_key(df: DataFrame) -> DataFrame:
    return df.withColumn("last_name_upper", F.upper("last_name"))


def lookup_from_terms(members: DataFrame, terms: DataFrame, congresses: list[int] | None = None, chamber: str = "house") -> DataFrame:
    """Terms in one chamber (and the listed congresses) with member attributes."""
    t = terms.filter(F.col("chamber") == chamber)
    if congresses:
        t = t.filter(F.col("congress").isin(congresses))
    t = t.select("bioguide_id", "congress").distinct()
    return with_name_key(t.join(members.select(*MEMBER_COLS), "bioguide_id", "left"))


def lookup_from_hearings(hearing_members: DataFrame, members: DataFrame, hearings: DataFrame) -> DataFrame:
    """Distinct (member, congress) pairs seen at hearings, with member attributes."""
    seen = hearing_members.join(hearings.select("hearing_id", "congress"), "hearing_id").select("bioguide_id", "congress")
    return with_name_key(seen.distinct().join(members.select(*MEMBER_COLS), "bioguide_id", "left"))


def hearing_member_map(hearing_members: DataFrame, members: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Members of hearings with their attributes.

    With `asked` (hearing_id, name) it holds only bioguide_id and last_name_upper of all rows under an asked name, few others,
    and `_n`, the number of rows a row stands for. A hearing's asked names go to its members as bits of one number and the names of an id
    as one array, so rows that nobody asks for are never made, however many members share an id.
    """
    if asked is None:
        return with_name_key(hearing_members.join(members.select(*MEMBER_COLS), "bioguide_id", "left"))
    wanted = asked.filter(F.col("name").isNotNull()).groupBy("hearing_id").agg(F.bit_or(_name_bits(F.col("name"))).alias("_asked"))
    known = with_name_key(members.select("bioguide_id", "last_name")).filter(F.col("last_name_upper").isNotNull())
    known = known.groupBy("bioguide_id", "last_name_upper").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct("last_name_upper", "_n", _name_bits(F.col("last_name_upper")).alias("bits"))
    called = known.groupBy("bioguide_id").agg(F.collect_list(entry).alias("_called"))
    seen = hearing_members.select("hearing_id", "bioguide_id").join(wanted, "hearing_id").join(called, "bioguide_id")
    fits = F.filter("_called", lambda x: x["bits"].bitwiseAND(F.col("_asked")) == x["bits"])
    return seen.select("hearing_id", "bioguide_id", F.explode(fits).alias("_x")).select("hearing_id", "bioguide_id", "_x.last_name_upper", "_x._n")


def _name_bits(name: Column) -> Column:
    """Two of 64 bits that stand for a name."""
    h, one = F.xxhash64(name), F.lit(1).cast("long")
    low, high = (F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int") for at in (0, 6))
    return F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))


def combined_lookup(*sources: DataFrame) -> DataFrame:
    """Several lookups, the first source winning per (member, congress)."""
    return rel.ranked_union(["bioguide_id", "congress"], ["last_name"], *sources)


# ---- covariates ----------------------------------------------------------------------


def seniority(ideology: DataFrame, congresses: list[int] | None = None, chamber: str = "House") -> DataFrame:
    """Terms served up to and including each congress; the full history is counted first.

    The window holds one row per congress a member served in, which the number of
    congresses bounds.
    """
    terms = ideology.filter(F.col("chamber") == chamber).select("bioguide_id", "congress").distinct()
    w = Window.partitionBy("bioguide_id").orderBy("congress")
    out = terms.withColumn("seniority", F.row_number().over(w))
    out = out.withColumn("seniority_sq", F.col("seniority") * F.col("seniority")).withColumn(
        "freshman", (F.col("seniority") == 1).cast("int")
    )
    return out.filter(F.col("congress").isin(congresses)) if congresses else out


def at_large_district(state, district) -> Column:
    return F.when(state.isin(*AT_LARGE_STATES) & (district == 1), 0).otherwise(district)


def ideology_covariates(ideology: DataFrame, congresses: list[int] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per (member, congress): scores, district, gender flag, seniority, within-congress ranks."""
    house = ideology.filter(F.col("chamber") == "House")
    target = house.filter(F.col("congress").isin(congresses)) if congresses else house
    cols = ["bioguide_id", "congress", "nominate_dim1", "nominate_dim2", "state_abbrev", "district_code"]
    cols += ["gender"] if "gender" in ideology.columns else []
    extra = [c for c in (order or []) if c not in cols]
    one = rel.first_by(target.select(*cols, *extra), ["bioguide_id", "congress"], order or ["state_abbrev", "district_code", "nominate_dim1"])
    one = one.drop(*extra).withColumn("district_code", at_large_district(F.col("state_abbrev"), F.col("district_code")))
    one = one.withColumn("abs_dwnom1", F.abs("nominate_dim1"))
    if "gender" in cols:
        one = one.withColumn("female", F.coalesce(F.col("gender") == "F", F.lit(False)).cast("int"))
    out = one.join(seniority(ideology, congresses), ["bioguide_id", "congress"], "left")
    for c in ("abs_dwnom1", "seniority"):
        out = ranking.percent_rank_avg(out, ["congress"], c, f"{c}_rs")
    # Seniority is at least 1, so its square ranks the same.
    return out.withColumn("seniority_sq_rs", F.col("seniority_rs"))


def winning_shares(elections: DataFrame, congresses: list[int] | None = None) -> DataFrame:
    """Largest vote share per (state, district, congress); missing or zero totals count as 100 %."""
    e = elections.withColumn("congress", dates.election_congress(F.col("year")))
    if congresses:
        e = e.filter(F.col("congress").isin(congresses))
    share = F.try_divide("candidatevotes", F.nullif(F.col("totalvotes"), F.lit(0.0))) * 100
    e = e.withColumn("_share", F.coalesce(share, F.lit(100.0))).withColumn("_imputed", share.isNull().cast("int"))
    e = e.withColumn("district_code", F.coalesce(F.col("district").try_cast("double").cast("int"), F.lit(0)))
    out = e.groupBy(F.col("state_po").alias("state_abbrev"), "district_code", "congress").agg(
        F.max("_share").alias("vote_pct"), F.max("_imputed").alias("vote_imputed")
    )
    return out.withColumn("vote_pct_sq", F.col("vote_pct") * F.col("vote_pct"))


def party_name(party) -> Column:
    p = F.trim(party)
    return F.when(p == "Democrat", "Democratic").otherwise(p)


def minority(party, congress, majority: dict[int, str] | None = None) -> Column:
    """1 outside the majority party, 0 inside, null when party or majority is unknown."""
    maj = F.try_element_at(literal_map(majority or HOUSE_MAJORITY), congress)
    return F.when(party.isNotNull() & maj.isNotNull(), (party_name(party) != maj).cast("int"))


def party_flags(df: DataFrame, majority: dict[int, str] | None = None, unified: dict[int, int] | None = None) -> DataFrame:
    """minority, unified, minuni and dem from party and congress."""
    df = df.withColumn("minority", minority(F.col("party"), F.col("congress"), majority))
    df = df.withColumn("unified", F.try_element_at(literal_map(unified or UNIFIED_GOVERNMENT), F.col("congress")))
    return df.withColumn("minuni", F.col("minority") * F.col("unified")).withColumn(
        "dem", (party_name(F.col("party")) == "Democratic").cast("int")
    )


def control_flags(df: DataFrame, divided_house: str = "divided_house", divided_senate: str = "divided_senate", dem_majority: str = "dem_maj") -> DataFrame:
    """trifecta, dem_in_maj and rep_in_maj, 0 or 1, from `dem` and who controls what; null where a value it needs is unknown.

    A trifecta is a president whose party holds both chambers. Whatever is not a Democrat counts as a Republican.
    """
    house, senate, maj = F.col(divided_house), F.col(divided_senate), F.col(dem_majority)

    def flag(a: Column, b: Column) -> Column:
        return (a & b).cast("int")

    return df.withColumns({
        "trifecta": flag(house == 0, senate == 0),
        "dem_in_maj": flag(F.col("dem") == 1, maj == 1),
        "rep_in_maj": flag(F.col("dem") == 0, maj == 0),
    })


def leaders_from_nested(nested: DataFrame, congresses: list[int] | None = None) -> DataFrame:
    """(congress, thomas_id, chair array, ranking_member array) -> one row per role and person."""
    if congresses:
        nested = nested.filter(F.col("congress").isin(congresses))
    flat = nested.unpivot(["congress", "thomas_id"], ["chair", "ranking_member"], "role", "ids")
    return flat.select("congress", "thomas_id", "role", F.posexplode("ids").alias("ord", "bioguide_id"))


def leadership_flags(df: DataFrame, leaders: DataFrame) -> DataFrame:
    """chairspeech, rankmemspeech and leader for each row's member, congress and committee."""
    roles = (
        leaders.groupBy("bioguide_id", "congress", F.col("thomas_id").alias("_thomas"))
        .agg(
            F.max((F.col("role") == "chair").cast("int")).alias("chairspeech"),
            F.max((F.col("role") == "ranking_member").cast("int")).alias("rankmemspeech"),
        )
    )
    out = df.withColumn("_thomas", names.parent_committee(F.col("committee_code"))).join(
        roles, ["bioguide_id", "congress", "_thomas"], "left"
    )
    out = out.drop("_thomas").fillna(0, ["chairspeech", "rankmemspeech"])
    out = out.withColumn("leader", F.greatest("chairspeech", "rankmemspeech"))
    return out.select(*df.columns, "chairspeech", "rankmemspeech", "leader")
