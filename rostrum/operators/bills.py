"""Bill tables, participants and stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bills as b
from . import relational as rel
from .stats import share_of_max

# House majority by congress, as bill files name the parties.
BILL_MAJORITY = {
    105: "Republican",
    106: "Republican",
    107: "Republican",
    108: "Republican",
    109: "Republican",
    110: "Democrat",
    111: "Democrat",
    112: "Republican",
    113: "Republican",
    114: "Republican",
    115: "Republican",
    116: "Democrat",
    117: "Democrat",
    118: "Republican",
}


def bill_table(raw: DataFrame) -> DataFrame:
    """Nested bill documents -> last status, congress, label, pass flags, member references."""
    last = b.last_where(F.col("actions"), lambda a: a["status"].isNotNull() & a["acted_at"].isNotNull())
    df = raw.withColumn("_last", last)
    return df.select(
        "bill_id",
        b.id_congress(F.col("bill_id")).alias("congress"),
        b.id_label(F.col("bill_id")).alias("bill_number"),
        F.col("_last.status").alias("status"),
        F.col("_last.acted_at").alias("status_at"),
        b.passed(F.col("_last.status"), b.HOUSE_PASSED).alias("house_pass"),
        b.passed(F.col("_last.status"), b.ENACTED).alias("law_pass"),
        F.when(F.col("sponsor").isNotNull(), b.member_ref(F.col("sponsor"))).alias("sponsor"),
        F.transform("cosponsors", b.member_ref).alias("cosponsors"),
    )


def sponsor_scores(bill_df: DataFrame, majority: dict[int, str] | None = None) -> DataFrame:
    """Cosponsor counts, bipartisanship, moderation and extremism per bill."""
    cos, party = F.col("cosponsors"), F.col("sponsor_party")
    n, r, d = F.col("num_cosponsors"), F.col("num_republican"), F.col("num_democrat")
    df = bill_df.withColumns(
        {
            "sponsor_party": F.col("sponsor.party"),
            "num_cosponsors": b.count_where(cos),
            "num_republican": b.count_where(cos, lambda c: c["party"] == "Republican"),
            "num_democrat": b.count_where(cos, lambda c: c["party"] == "Democrat"),
            "majority_party": F.try_element_at(b._map(majority or BILL_MAJORITY), F.col("congress")),
        }
    )
    df = df.withColumns(
        {
            "bipartisan": b.bipartisan(party, cos).cast("int"),
            "sponsor_majority": F.when(
                F.col("majority_party").isNotNull(), F.coalesce(party == F.col("majority_party"), F.lit(False)).cast("int")
            ),
            "bipartisanship_intensity": b.bipartisan_intensity(party, F.col("majority_party"), n, r, d),
            "moderation_score": b.moderation(party, n, r, d),
            "extremism_score": b.extremism(n, r, d),
            "log_num_cosponsors": F.log1p(n),
        }
    )
    df = share_of_max(df, "log_num_cosponsors", "log_scaled")
    return df.withColumn("moderation_standardized", F.col("moderation_score") * F.col("log_scaled"))


def unmatched_members(bill_df: DataFrame, lookup: DataFrame, id_col: str) -> DataFrame:
    """Sponsor ids that the lookup does not know."""
    ids = bill_df.select(F.col("sponsor.member_id").alias(id_col)).filter(F.col(id_col).isNotNull()).distinct()
    return rel.keep_not_in(ids, lookup, id_col)


def split_rows(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    """One row per item of a delimited field, blanks trimmed."""
    return df.withColumn(col, F.explode(F.split(col, sep))).withColumn(col, F.trim(col))


def flatten_people(df: DataFrame, key: str, people: str) -> DataFrame:
    """Array of participants -> rows with the parent key and a number from 1."""
    flat = df.select(key, F.posexplode(people).alias("_i", "_p"))
    return flat.select(key, (F.col("_i") + 1).cast("bigint").alias("num"), F.col("_p.*"))


def numbered_people(people):
    """Number participants and merge the person spoken for into the element."""
    return F.transform(
        people,
        lambda p, i: F.struct(
            (i + 1).cast("bigint").alias("num"),
            p["lname"].alias("lname"),
            p["role"].alias("role"),
            p["proxy"]["lname"].alias("proxy_for_lname"),
            p["proxy"]["role"].alias("proxy_for_role"),
        ),
    )


def control_table(raw: DataFrame, low: int = 104, high: int = 119) -> DataFrame:
    """Party-control text table -> years, party code, seat margin and its 0.1-0.5 scaling."""
    from .stats import scaled

    df = raw.withColumn("congress_number", F.regexp_extract("congress", r"(\d+)", 1).try_cast("int"))
    df = df.filter(F.col("congress_number").between(low, high))
    df = df.select(
        "congress_number",
        F.regexp_extract("years", r"(\d{4})\D+(\d{4})", 1).try_cast("int").alias("start_year"),
        F.regexp_extract("years", r"(\d{4})\D+(\d{4})", 2).try_cast("int").alias("end_year"),
        F.when(F.col("maj_party") == "Dem", "D").when(F.col("maj_party") == "Rep", "R").alias("majority_party"),
        F.abs("seat_diff").alias("seat_margin"),
    )
    return scaled(df, "seat_margin", "power_gap_scaled", 0.1, 0.5)


def html_rows(pages: DataFrame, key: str, html: str = "html", tag: str = "tr") -> DataFrame:
    """Rows of stored HTML: one per element, with its text cells and link targets."""
    rows = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    flat = pages.select(key, F.posexplode(rows).alias("row_no", "_row"))
    cells = F.transform(
        F.regexp_extract_all(F.col("_row"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)),
        lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " ")),
    )
    links = F.regexp_extract_all(F.col("_row"), F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    return flat.select(key, F.col("row_no").cast("bigint").alias("row_no"), cells.alias("cells"), links.alias("links"), "_row")


def hearing_events(pages: DataFrame, key: str, congress: int, html: str = "html") -> DataFrame:
    """Transcript-table pages -> one row per event with the bills it cites."""
    r = html_rows(pages, key, html).filter(F.size("cells") >= 4)
    cell = lambda i: F.get("cells", F.lit(i))
    event = F.regexp_extract(cell(0), r"(?i)\bEvent\s+(\d+)\b", 1).try_cast("int")
    from_links = F.filter(F.transform("links", b.bill_from_url), lambda x: x.isNotNull())
    cited = F.array_distinct(
        F.concat(from_links, b.citations(F.coalesce(cell(4), F.lit("")), F.lit(congress)), b.citations(cell(2), F.lit(congress)))
    )
    out = r.select(
        key, event.alias("event_id"), cell(1).alias("date"), cell(2).alias("title"), cell(3).alias("committee"), cited.alias("_b")
    ).filter(F.col("event_id").isNotNull())
    out = out.withColumn("has_bill", (F.size("_b") > 0).cast("int")).withColumn(
        "bill_numbers", F.array_join(F.transform("_b", lambda x: b.bill_label(x["bill_type"], x["bill_number"])), "; ")
    )
    return rel.first_by(out.drop("_b"), ["event_id"], [key, "date", "title"])
