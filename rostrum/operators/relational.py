"""Keyed de-duplication, joins, set operations, reshaping and limits.

Joins carry no broadcast hints: Spark broadcasts a side only when its measured size
is under `spark.sql.autoBroadcastJoinThreshold`, and AQE splits skewed partitions of
the joins that shuffle. De-duplication is a `min_by`/`max_by` aggregate rather than
a window, so it combines before the shuffle and a hot key never sits in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(items) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row with the smallest `order` per key. End the order with a unique column."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*_cols(order)))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row with the largest `order` per key."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*_cols(order)))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ranked_union(keys: list[str], order: list, *frames: DataFrame, later_wins: bool = False) -> DataFrame:
    """Union of sources in which one source wins per key: the first, or the last."""
    tagged = [f.withColumn("_src", F.lit(-i if later_wins else i)) for i, f in enumerate(frames)]
    return first_by(union_all(*tagged), keys, ["_src", *order]).drop("_src")


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fail the job, when it runs, if a key occurs twice; otherwise pass the rows on.

    The check is part of the plan (one aggregate), not a separate count.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("_r"))
    checked = grouped.withColumn(
        "_r",
        F.when(F.col("_n") == 1, F.col("_r")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys))))
        ),
    )
    return checked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], *, validate: bool = False) -> DataFrame:
    """Left join that keeps the left row count; `validate` enforces unique right keys."""
    return left.join(require_unique(right, keys) if validate else right, keys, "left")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], nullable: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null equals null for the `nullable` keys only."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, *nullable) else F.col(c) for c in right.columns])
    cond = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in nullable]
    return left.join(r, reduce(lambda a, b: a & b, cond), how).drop(*[f"_r_{k}" for k in (*keys, *nullable)])


#: A block of a bitmap is a row of so many 64-bit words; listed keys that share a block; blocks that are broadcast at most.
WORDS, KEYS_A_BLOCK, MOST_BLOCKS = 8, 32, 1 << 19


def perhaps_listed(df: DataFrame, listed: DataFrame, keys: list[str], n: int) -> tuple[DataFrame, Column]:
    """`df` with columns more, and a condition on them: true for every row whose keys are `listed`, for few others, never null.

    Rows that fail it need not move for a join with `listed`. Two bits of a word are set per listed key, about `n` of them, in a
    bitmap that is broadcast: 2 bytes a key and 32 MB at most. Then about one other row in fifty passes; a list of over 17
    million keys lets more pass, never fewer. The keys must have the same types on both sides; nulls count as equal.
    """
    blocks = max(1, min(MOST_BLOCKS, -(-n // KEYS_A_BLOCK)))
    h = F.xxhash64(*keys)
    block = F.pmod(h.bitwiseAND(F.lit((1 << 45) - 1)), F.lit(blocks)).alias("_block")
    word = F.shiftrightunsigned(h, 45).bitwiseAND(F.lit(WORDS - 1)).alias("_word")
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")) for at in (48, 54)]
    named = (block, word, bits[0].bitwiseOR(bits[1]).alias("_mask"))
    words = [F.bit_or(F.when(F.col("_word") == k, F.col("_mask"))).alias(f"_w{k}") for k in range(WORDS)]
    # The one side whose size does not depend on statistics: it is bounded above.
    marks = F.broadcast(listed.select(*named).groupBy("_block").agg(*words))
    its = F.coalesce(*[F.when(F.col("_word") == k, F.col(f"_w{k}")) for k in range(WORDS)], F.lit(0).cast("long"))
    return df.select("*", *named).join(marks, "_block", "left"), its.bitwiseAND(F.col("_mask")) == F.col("_mask")


def keep_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def keep_not_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def interval_join(df: DataFrame, point: str, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Left join of whole numbers into half-open [start, end) intervals, as an equi-join.

    Each interval is unrolled to the numbers it covers, so nothing is compared
    with rows outside it.
    """
    last = F.col(end) - 1
    covered = intervals.filter(last >= F.col(start)).withColumn(point, F.explode(F.sequence(F.col(start), last)))
    return df.join(covered, point, "left")


def route_by_id_type(df: DataFrame, lookup: DataFrame, id_col: str, type_col: str, routes: dict[str, str]) -> DataFrame:
    """Left join on one of several lookup keys, chosen per row by `type_col`.

    routes: {type value: lookup column}. The lookup is unrolled to (type, id) rows,
    which leaves a single equi-join.
    """
    ids = F.array(*[F.struct(F.lit(t).alias(type_col), F.col(c).alias(id_col)) for t, c in routes.items()])
    flat = lookup.withColumn("_k", F.explode(ids)).select("*", f"_k.{type_col}", f"_k.{id_col}").drop("_k")
    return df.join(flat.filter(F.col(id_col).isNotNull()), [type_col, id_col], "left")


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Projection of those columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def view(df: DataFrame, **choices) -> DataFrame:
    """Multi-select filters; an empty or absent choice filters nothing."""
    for col, values in choices.items():
        if values:
            df = df.filter(F.col(col).isin(list(values)))
    return df


def since(df: DataFrame, low: int, chamber: str | None = None, high: int | None = None) -> DataFrame:
    """Minimum (and maximum) congress with an optional chamber."""
    cond = F.col("congress") >= low
    if high is not None:
        cond = cond & (F.col("congress") <= high)
    if chamber is not None:
        cond = cond & (F.col("chamber") == chamber)
    return df.filter(cond)


def substantial(df: DataFrame, text_col: str = "raw_text", longer_than: int = 100) -> DataFrame:
    return df.filter(F.length(text_col) > longer_than)


def drop_sentinels(df: DataFrame, col: str, sentinels: list) -> DataFrame:
    """Rows whose value is present and not one of the error markers."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(sentinels))


def around(df: DataFrame, col: str, k: int, centre: int = 0) -> DataFrame:
    return df.filter(F.abs(F.col(col) - centre) <= k)


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    return counts.orderBy(F.desc("count"), key).limit(k)


def placed(groups: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """A table of groups in order, with each one's place; made for categories, whose number is bounded."""
    return groups.withColumn(out, F.row_number().over(Window.orderBy(*order))).orderBy(out)


def best_and_worst(df: DataFrame, score: str, ties: list[str], k: int = 10) -> DataFrame:
    """Top k and bottom k rows by a score, tagged by side and rank."""
    def side(name: str, order):
        cut = df.orderBy(order, *ties).limit(k).withColumn("side", F.lit(name))
        return cut.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(order, *ties)))

    return side("top", F.desc(score)).unionByName(side("bottom", F.asc(score)))


def levels(df: DataFrame, col: str, limit: int = 10_000) -> list:
    """Distinct values of a category column, which become columns; `limit` bounds how many."""
    rows = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values and is not a category")
    return sorted(r[0] for r in rows)


def widen(df: DataFrame, keys: list[str], names: str, values: list, aggs: dict[str, str], fill=None) -> DataFrame:
    """Long to wide with one column per (aggregate, listed value). The job fails if a cell has two different values."""
    def single(v: str) -> Column:
        return F.when(F.min(v).eqNullSafe(F.max(v)), F.min(v)).otherwise(F.raise_error(F.lit(f"two values of {v} in one cell")))

    exprs = [single(v).alias(out) for out, v in aggs.items()]
    wide = df.groupBy(*keys).pivot(names, values).agg(*exprs)
    return wide if fill is None else wide.fillna(fill)


def lengthen(df: DataFrame, keys: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, cols, name, value)


def complete_grid(counts: DataFrame, key: str, category: str, categories: list, value: str) -> DataFrame:
    """Every (key, category) combination, absent ones filled with 0."""
    cells = F.explode(F.array(*[F.lit(c) for c in categories]))
    grid = counts.select(key).distinct().select(key, cells.alias(category))
    return grid.join(counts, [key, category], "left").fillna(0, [value])
