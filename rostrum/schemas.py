"""Explicit schemas (as DDL text) for the source tables, and conforming a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


HEARINGS = "hearing_id string, congress int, chamber string, title string"
HEARING_TEXTS = "hearing_id string, raw_text string"
HEARING_MEMBERS = "hearing_id string, bioguide_id string"
HEARING_COMMITTEES = "hearing_id string, committee_code string, committee_name string"
HEARING_DATES = "hearing_id string, hearing_date string"
MEMBERS = "bioguide_id string, last_name string, first_name string, party string, state string"
TERMS = "bioguide_id string, congress int, chamber string, state_code string"
IDEOLOGY = (
    "congress int, chamber string, bioguide_id string, nominate_dim1 double, nominate_dim2 double, "
    "state_abbrev string, district_code int, gender string"
)
ELECTIONS = "year int, state_po string, district string, candidatevotes double, totalvotes double"
LEADERS = "congress int, thomas_id string, role string, bioguide_id string"

_BILL_MEMBER = "struct<bioguide_id:string,thomas_id:string,name:string,state:string,party:string>"
BILLS = (
    "bill_id string, official_title string, short_title string, status string, "
    "actions array<struct<status:string,acted_at:string>>, "
    f"sponsor {_BILL_MEMBER}, cosponsors array<{_BILL_MEMBER}>"
)
PACKAGE_PAGE = (
    "packages array<struct<packageId:string,title:string,congress:string,dateIssued:string,"
    "chamber:string,docClass:string,lastModified:string>>"
)

# Types of the narrow enriched table, for columns that are present.
NARROW_TYPES = {
    "congress": "smallint",
    "seniority_sq": "smallint",
    **{
        c: "tinyint"
        for c in (
            "dem minority unified minuni freshman chairspeech rankmemspeech leader female district_code seniority"
        ).split()
    },
    **{c: "string" for c in "chamber party match_type member_state state_abbrev".split()},
}


def struct(schema: str | T.StructType) -> T.StructType:
    """A schema given as DDL text or as a struct type."""
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Select exactly the schema's columns; absent ones become typed nulls, bad values null."""
    cols = []
    for f in struct(schema).fields:
        if f.name in df.columns:
            same = df.schema[f.name].dataType == f.dataType
            cols.append(F.col(f.name) if same else F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def narrow(df: DataFrame, renames: dict[str, str] | None = None, date_col: str = "hearing_date") -> DataFrame:
    """Rename, then narrow the columns that are present; values that do not fit become null."""
    for old, new in (renames or {"target_sentence": "text"}).items():
        df = df.withColumnRenamed(old, new)
    cols = []
    for c in df.columns:
        if c == date_col:
            cols.append(F.col(c).try_cast("timestamp").alias(c))
        elif c in NARROW_TYPES:
            cols.append(F.col(c).try_cast(NARROW_TYPES[c]).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
