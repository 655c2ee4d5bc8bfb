"""Order-dependent operators that never sort a whole key in one task.

A window partitioned by `hearing_id` alone would put a hearing with a third of all
rows into one task. Here each key is cut into blocks of its position column. Blocks
are summarised to one row each, a window runs over those summaries only, and the
rows are finished inside (key, block) windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SPAN = 1 << 16


def with_ordered(
    df: DataFrame,
    keys: list[str],
    pos: str,
    *,
    span: int = DEFAULT_SPAN,
    block: Column | None = None,
    running: dict[str, str] | None = None,
    carry: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add order-dependent columns over `pos`, unique inside a key: integral and cut into blocks of
    `span`, or a struct with `block`, a column that never falls as `pos` grows.

    running: {out: value}  inclusive running sum, null counts as 0
    carry:   {out: value}  last non-null value so far
    lag/lead:{out: value}  neighbouring row's value
    number:  out           1-based row number
    """
    running, carry, lag, lead = running or {}, carry or {}, lag or {}, lead or {}
    blk = "_block"
    rows = df.withColumn(blk, F.floor(F.col(pos) / F.lit(span)) if block is None else block)

    aggs = []
    if number:
        aggs.append(F.count(F.lit(1)).alias("_n"))
    for out, v in running.items():
        aggs.append(F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"_sum_{out}"))
    for out, v in carry.items():
        aggs.append(F.max(F.when(F.col(v).isNotNull(), F.struct(F.col(pos), F.col(v)))).alias(f"_car_{out}"))
    for out, v in lag.items():
        aggs.append(F.max_by(F.struct(F.col(v).alias("v")), F.col(pos)).alias(f"_lag_{out}"))
    for out, v in lead.items():
        aggs.append(F.min_by(F.struct(F.col(v).alias("v")), F.col(pos)).alias(f"_lead_{out}"))
    blocks = rows.groupBy(*keys, blk).agg(*aggs)

    over = Window.partitionBy(*keys).orderBy(blk)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    edge = [*keys, blk]
    if number:
        edge.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    for out in running:
        edge.append(F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_sum_{out}"))
    for out, v in carry.items():
        edge.append(F.last(f"_car_{out}", ignorenulls=True).over(before)[v].alias(f"_car_{out}"))
    for out in lag:
        edge.append(F.lag(f"_lag_{out}").over(over)["v"].alias(f"_lag_{out}"))
    for out in lead:
        edge.append(F.lead(f"_lead_{out}").over(over)["v"].alias(f"_lead_{out}"))
    edges = blocks.select(*edge)

    joined = rows.join(edges, [*keys, blk])
    inner = Window.partitionBy(*keys, blk).orderBy(pos)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.col(c) for c in df.columns]
    if number:
        cols.append((F.row_number().over(inner) + F.col("_n")).cast("bigint").alias(number))
    for out, v in running.items():
        cols.append((F.sum(F.coalesce(F.col(v), F.lit(0))).over(upto) + F.col(f"_sum_{out}")).alias(out))
    for out, v in carry.items():
        cols.append(F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_car_{out}")).alias(out))
    first = F.row_number().over(inner) == 1
    final = F.lead(F.lit(1)).over(inner).isNull()
    for out, v in lag.items():
        cols.append(F.when(first, F.col(f"_lag_{out}")).otherwise(F.lag(v).over(inner)).alias(out))
    for out, v in lead.items():
        cols.append(F.when(final, F.col(f"_lead_{out}")).otherwise(F.lead(v).over(inner)).alias(out))
    return joined.select(*cols)
