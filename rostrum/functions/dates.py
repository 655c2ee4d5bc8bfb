"""Dates, congress numbers, chambers and package ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(col) -> Column:
    """Timestamp from text, null when it cannot be read."""
    return F.try_to_timestamp(col)


def election_congress(year) -> Column:
    """Election year -> congress it elects."""
    return (F.floor((year - 1788) / 2) + 1).cast("int")


def session_start(congress) -> Column:
    """First day of a congress: 3 January of its odd year."""
    return F.make_date((F.lit(1787) + congress * 2).cast("int"), F.lit(1), F.lit(3))


def in_session(day, congress, grace_days: int = 0) -> Column:
    """start <= day < end (+ grace)."""
    return (day >= session_start(congress)) & (day < F.date_add(session_start(congress + 1), grace_days))


def month_starts(year) -> Column:
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.sequence(first, F.make_date(year, F.lit(12), F.lit(1)), F.expr("interval 1 month"))


def quarter_starts(year) -> Column:
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.sequence(first, F.make_date(year, F.lit(10), F.lit(1)), F.expr("interval 3 months"))


def year_of(text) -> Column:
    return F.substring(text, 1, 4).try_cast("int")


def month_of(text) -> Column:
    return F.substring(text, 6, 2).try_cast("int")


def is_house_package(pid, joint: bool = False) -> Column:
    kinds = "hhrg|jhrg" if joint else "hhrg"
    return F.coalesce(pid.rlike(rf"(?i)^CHRG-\d+({kinds})"), F.lit(False))


def package_chamber(pid) -> Column:
    """house / senate / joint from a package id, else null."""
    low = F.lower(pid)
    return (
        F.when(low.rlike(r"^chrg-\d+hhrg"), "house")
        .when(low.rlike(r"^chrg-\d+shrg"), "senate")
        .when(low.rlike(r"^chrg-\d+jhrg"), "joint")
    )


def text_chamber(col) -> Column:
    """house / senate / joint from free text; joint wins over the two it names."""
    low = F.lower(col)
    return F.when(low.contains("joint"), "joint").when(low.contains("house"), "house").when(low.contains("senate"), "senate")
