"""Category, label and bin expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an oversight hearing.
OVERSIGHT_WORDS = (
    "oversight",
    "review",
    "report",
    "budget request",
    "control",
    "impact",
    "information",
    "investigation",
    "request",
    "explanation",
    "president",
    "administration",
    "contract",
    "consultation",
    "examination",
)


def oversight_class(description) -> Column:
    """`oversight` when one of the oversight words occurs, else `legislative`."""
    hit = F.coalesce(description.rlike("(?i)" + "|".join(OVERSIGHT_WORDS)), F.lit(False))
    return F.when(hit, "oversight").otherwise("legislative")


def is_legislative(kind) -> Column:
    return F.when(kind == "legislative", 1).when(kind == "oversight", 0)


def share_category(x) -> Column:
    """Share of one party: near 0, near 1, near one half, or other."""
    return (
        F.when(x <= 0.10, "low").when(x >= 0.90, "high").when((x >= 0.45) & (x <= 0.55), "even").otherwise("other")
    )


def cut(x, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins by upper edges; the last label is open above. Null stays null."""
    out = F.when(x.isNull(), None)
    for edge, label in zip(edges, labels):
        out = out.when(x <= edge, label)
    return out.otherwise(labels[-1])


def role_label(chair, ranking) -> Column:
    """Committee role; the ranking-member label wins if both flags are set."""
    # The three labels.
    return (
        F.when(ranking == 1, "Ranking Member (Minority Lead)")
        .when(chair == 1, "Committee Chair (Majority Lead)")
        .otherwise("Regular Member")
    )


def mapped(col, labels: dict) -> Column:
    out = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.try_element_at(out, col)


def minority_share(ratio) -> Column:
    """Smaller party's share, from one party's share."""
    return F.least(ratio, 1 - ratio)


def majority_by_year(year) -> Column:
    """House majority by year, for the years covered."""
    return (
        F.when(year.between(1996, 2006), "R").when(year.between(2007, 2010), "D").when(year.between(2011, 2016), "R")
    )


def interval_index(x, breaks: list[float]) -> Column:
    """Number of breaks not above x."""
    out = F.lit(0)
    for b in breaks:
        out = out + (x >= b).cast("int")
    return out


def first_year(label) -> Column:
    return F.regexp_extract(label, r"(\d{4})", 1).try_cast("int")
