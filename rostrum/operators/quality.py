"""Profiles and data-quality rules, each as one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates


#: Characters of a value that a profile shows, and how many values.
PREVIEW, SAMPLES = 40, 3


def _plain(df: DataFrame, col: str) -> Column:
    """The column as equal values hash alike: maps by their sorted entries, without negative zeros."""
    kind, named = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(named))
    return named + F.lit(0).cast(kind) if isinstance(kind, T.FractionalType) else named


def _shown(df: DataFrame, col: str) -> Column:
    value = _plain(df, col)
    atomic = not isinstance(df.schema[col].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    return F.substring(value.cast("string") if atomic else F.to_json(F.struct(value.alias("v"))), 1, PREVIEW)


def value_cells(df: DataFrame, cols: list[str], preview: bool = False) -> DataFrame:
    """(col, h1, h2, shown, n): every different value of each column by 128 bits of its hash, with its number of rows.

    One shuffle for all columns. A row gives a narrow hash for each column, which are counted before the shuffle, so
    values are never copied and a value that a third of all rows hold is one row of each task.
    """
    def cell(i: int, c: str) -> Column:
        v = _plain(df, c)
        shown = _shown(df, c) if preview else F.lit(None).cast("string")
        hashed = F.struct(F.lit(i).alias("col"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("2"), v).alias("h2"), shown.alias("shown"))
        return F.when(v.isNotNull(), hashed).otherwise(F.struct(F.lit(i).alias("col"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(None).cast("string").alias("shown")))

    cells = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(cols)])).alias("x")).select("x.*")
    return cells.groupBy("col", "h1", "h2", "shown").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row with the number of different non-null values of each column: {out: column}."""
    found = value_cells(df, list(cols.values())).filter(F.col("h1").isNotNull())
    per = found.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(*[F.coalesce(F.sum(F.when(F.col("col") == i, F.col("n"))), F.lit(0)).alias(out) for i, out in enumerate(cols)])


def profile(df: DataFrame) -> DataFrame:
    """Per column, text included: type, rows, null share, exact distinct count and three sample values.

    The samples are the beginnings of the three different values with the smallest hash, a draw that repeats
    anywhere. `sketches` is the approximate form for tables whose different values are too many to shuffle.
    """
    cells = value_cells(df, df.columns, preview=True)
    some = F.col("h1").isNotNull()
    counts = cells.groupBy("col").agg(F.sum("n").alias("rows"), F.sum(F.when(some, F.col("n")).otherwise(0)).alias("filled"), F.count_if(some).alias("n_distinct"))
    nth = F.row_number().over(Window.partitionBy("col").orderBy("h1", "h2"))
    first = cells.filter(some).withColumn("nth", nth).filter(F.col("nth") <= SAMPLES)
    first = first.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("nth", "shown"))).alias("s")).select("col", F.col("s.shown").alias("samples"))
    names = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema.fields])
    out = counts.join(first, "col", "left").withColumn("f", F.get(names, F.col("col")))
    empty = F.array().cast("array<string>")
    return out.select("f.column", "f.type", "rows", (1 - F.col("filled") / F.col("rows")).alias("null_share"), "n_distinct", F.coalesce("samples", empty).alias("samples"))


def sketches(df: DataFrame, log_size: int = 12) -> DataFrame:
    """Per column: type, rows, filled rows and a sketch of its different values. One pass, no shuffle of values.

    The sketches of parts of a table, or of a table and what was added later, are put together by `from_sketches`.
    """
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[x for i, f in enumerate(fields) for x in (
        F.count(F.col(f"`{f.name}`")).alias(f"_c{i}"),
        F.hll_sketch_agg(F.when(F.col(f"`{f.name}`").isNotNull(), F.xxhash64(_plain(df, f.name))), log_size).alias(f"_s{i}"))])
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_n").alias("rows"), F.col(f"_c{i}").alias("filled"), F.col(f"_s{i}").alias("sketch")) for i, f in enumerate(fields)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def from_sketches(parts: DataFrame) -> DataFrame:
    """(column, type, rows, null_share, n_distinct) of the whole from the sketches of its parts; the count is an estimate."""
    whole = parts.groupBy("column", "type").agg(F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_union_agg("sketch").alias("sketch"))
    return whole.select("column", "type", "rows", (1 - F.col("filled") / F.nullif("rows", F.lit(0))).alias("null_share"), F.hll_sketch_estimate("sketch").alias("n_distinct"))


def overview(df: DataFrame, required: list[str], score: str) -> DataFrame:
    """Row count, null counts of the listed columns and a mean score, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in required], F.avg(score).alias("mean_score")
    )


def overview_by(df: DataFrame, categories: list[str], required: list[str], score: str) -> DataFrame:
    """(item, value, rows, nulls by column, mean_score): the overview of the table, under the item `all`, and of each value of
    each category. One pass; a row counts once for every category, before the shuffle."""
    kinds = [F.struct(F.lit("all").alias("item"), F.lit(None).cast("string").alias("value"))]
    kinds += [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in categories]
    rows = df.select(F.explode(F.array(*kinds)).alias("_k"), *[F.col(c).isNull().alias(f"_null_{c}") for c in required], F.col(score).alias("_score"))
    return rows.groupBy("_k.item", "_k.value").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(f"_null_{c}").alias(f"{c}_nulls") for c in required], F.avg("_score").alias("mean_score"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """(column, state, rows, filled) per required column: `absent` from the schema, `empty` in every row, or `ok`."""
    have = [c for c in required if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(have)])
    filled = {c: F.col(f"_c{i}") for i, c in enumerate(have)}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in filled).alias("there"), F.col("_n").alias("rows"), filled.get(c, F.lit(0).cast("long")).alias("filled")) for c in required])
    state = F.when(~F.col("there"), "absent").when(F.col("filled") == 0, "empty").otherwise("ok")
    return row.select(F.explode(cells).alias("x")).select("x.*").select("column", state.alias("state"), "rows", "filled")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: how many rows break it. A null condition breaks nothing."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def enriched_rules() -> dict[str, Column]:
    """Rules of the enriched table: terms from 1, binary flags, scores within 0 and 100."""
    flags = "minority dem freshman chairspeech rankmemspeech leader female".split()
    rules = {"seniority_from_1": F.col("seniority") >= 1, "match_score_range": F.col("match_score").between(0, 100)}
    return {**rules, **{f"{c}_binary": F.col(c).isin(0, 1) for c in flags}}


#: Share of matched members that may lack an ideology score.
MAX_NULL_SHARE = 0.05


def share_violations(df: DataFrame, rules: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """(rule, n, share, ok) for rules {name: (rows it is about, what is counted among them, limit)}: the share must lie
    below the limit. A rule about no row is kept."""
    row = df.agg(*[x for i, (about, what, _) in enumerate(rules.values()) for x in (F.count_if(about).alias(f"_n{i}"), F.count_if(about & what).alias(f"_k{i}"))])
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_n{i}").alias("n"), (F.col(f"_k{i}") / F.nullif(F.col(f"_n{i}"), F.lit(0))).alias("share"), F.lit(float(limit)).alias("limit")) for i, (name, (_, _, limit)) in enumerate(rules.items())])
    return row.select(F.explode(cells).alias("x")).select("x.rule", "x.n", "x.share", F.coalesce(F.col("x.share") < F.col("x.limit"), F.lit(True)).alias("ok"))


def null_share_rules() -> dict[str, tuple[Column, Column, float]]:
    """Matched members have an ideology score, but for a few."""
    return {"ideology_of_matched": (F.col("bioguide_id").isNotNull(), F.col("nominate_dim1").isNull(), MAX_NULL_SHARE)}


def outside_session(df: DataFrame, day: str, congress: str, grace_days: int = 90) -> DataFrame:
    """Rows per congress dated outside its session plus a grace period."""
    ok = dates.in_session(F.col(day), F.col(congress), grace_days)
    return df.groupBy(congress).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("outside"))


def missing_percent(df: DataFrame, cols: list[str]) -> DataFrame:
    """Percent missing per column, worst first; columns that are absent are left out."""
    have = [c for c in cols if c in df.columns]
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in have])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_pct")) for c in have])
    return row.select(F.explode(cells).alias("x")).select("x.*").orderBy(F.desc("missing_pct"), "column")
