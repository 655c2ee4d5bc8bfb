"""Columns that are worth computing exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator.

    Filters and joins on a derived column are normally pushed below it by copying its
    expression, so a costly one (regular expressions, similarity) runs several times per
    row and swells the generated code. A generator's output is not copied.
    """
    rest = [c for c in df.columns if c not in cols]
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select(*df.columns, F.explode(packed).alias("_once")).select(*rest, *[F.col("_once")[n].alias(n) for n in cols])
