"""Ordered scans and group totals that stay exact and parallel for groups of any size.

Most tables hold only small groups (a receipt has some dozens of boxes); one shuffle by the group key then
serves every window. ``width_for`` measures the largest group first. If one is too large for a task, the scans
run in two levels instead: windows per (group, band of positions), and one row per band that carries the state
over to the next band. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = 256
#: Buckets of groups that are counted first; a map task sends one row per bucket.
BUCKETS = 1 << 16
LARGE_GROUP = 200_000
FIRST, BEFORE, HERE = Window.unboundedPreceding, -1, Window.currentRow


def width_for(df: DataFrame, group: str, limit: int = LARGE_GROUP) -> int | None:
    """None if every group fits one task, else the number of bands to use.

    Groups are counted by hash buckets first. Only the groups of buckets that hold more than ``limit`` rows are counted
    one by one, so no count travels per group unless a bucket is that full.
    """
    keyed = df.select(group).withColumn("_b", F.pmod(F.xxhash64(group), F.lit(BUCKETS)).cast("int"))
    full = [r["_b"] for r in keyed.groupBy("_b").count().filter(F.col("count") > limit).collect()]  # at most BUCKETS
    if not full:
        return None
    few = keyed if len(full) > 1000 else keyed.filter(F.col("_b").isin(full))
    sizes = few.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return None if sizes.filter(F.col("n") > limit).isEmpty() else BANDS


def _banded(df: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    """Rows with ``_band``: ``width`` ranges of the first order column, cut at measured quantiles.

    So a crowded page splits by its rows and not by its pixels; rows that tie in that column share a band.
    """
    cuts = df.agg(F.percentile_approx(order[0], [i / width for i in range(1, width)], 10_000).alias("_cuts"))
    rows = df.join(F.broadcast(cuts))  # one-row side
    return rows.withColumn("_band", F.size(F.filter("_cuts", lambda c: c <= F.col(order[0])))).drop("_cuts")


def _bands(group: str):
    return Window.partitionBy(group).orderBy("_band")


def group_totals(df: DataFrame, group: str, width: int | None = None, **aggregates: Column) -> DataFrame:
    """Every row with aggregates over its whole group."""
    if width is None:
        whole = Window.partitionBy(group)
        return df.select("*", *[a.over(whole).alias(name) for name, a in aggregates.items()])
    totals = df.groupBy(group).agg(*[a.alias(name) for name, a in aggregates.items()])
    return df.join(totals, group)


def lag_value(df: DataFrame, group: str, order: Sequence[str], value: str, out: str, width: int | None = None) -> DataFrame:
    """Value of the previous row of the group."""
    if width is None:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(group).orderBy(*order)))
    rows = _banded(df, order, width)
    last = rows.groupBy(group, "_band").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last.select(group, "_band", F.lag("_last").over(_bands(group)).alias("_carry"))
    w = Window.partitionBy(group, "_band").orderBy(*order)
    rows = rows.withColumn("_in", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return rows.join(carry, [group, "_band"]).withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in"))).drop("_band", "_in", "_first", "_carry")


def running_sum(df: DataFrame, group: str, order: Sequence[str], value: Column, out: str, width: int | None = None) -> DataFrame:
    """Sum of ``value`` over the group up to and including the row."""
    if width is None:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(FIRST, HERE)))
    rows = _banded(df.withColumn("_v", value), order, width)
    sums = rows.groupBy(group, "_band").agg(F.sum("_v").alias("_s"))
    carry = sums.select(group, "_band", F.coalesce(F.sum("_s").over(_bands(group).rowsBetween(FIRST, BEFORE)), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(group, "_band").orderBy(*order).rowsBetween(FIRST, HERE)
    return rows.withColumn("_in", F.sum("_v").over(inside)).join(carry, [group, "_band"]).withColumn(
        out, F.col("_carry") + F.col("_in")).drop("_band", "_in", "_carry", "_v")


def running_max_before(df: DataFrame, group: str, order: Sequence[str], value: Column, out: str,
                       width: int | None = None) -> DataFrame:
    """Maximum of ``value`` over the rows of the group before this one; NULL on the first row."""
    if width is None:
        return df.withColumn(out, F.max(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(FIRST, BEFORE)))
    rows = _banded(df.withColumn("_v", value), order, width)
    tops = rows.groupBy(group, "_band").agg(F.max("_v").alias("_s"))
    carry = tops.select(group, "_band", F.max("_s").over(_bands(group).rowsBetween(FIRST, BEFORE)).alias("_carry"))
    inside = Window.partitionBy(group, "_band").orderBy(*order).rowsBetween(FIRST, BEFORE)
    return rows.withColumn("_in", F.max("_v").over(inside)).join(carry, [group, "_band"]).withColumn(
        out, F.greatest("_carry", "_in")).drop("_band", "_in", "_carry", "_v")


def position(df: DataFrame, group: str, order: Sequence[str], out: str, width: int | None = None) -> DataFrame:
    """1-based position of the row in its group."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), out, width)


def segments(df: DataFrame, group: str, low: str, high: str, tie: Sequence[str], out: str, strict: bool = False,
             width: int | None = None) -> DataFrame:
    """Number of the connected run of intervals [low, high] each row belongs to."""
    order = [low, *tie]
    rows = running_max_before(df, group, order, F.col(high), "_top", width)
    gap = F.col(low) > F.col("_top") if strict else F.col(low) >= F.col("_top")
    starts = F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0).cast("bigint")
    return running_sum(rows, group, order, starts, out, width).drop("_top")


def neighbours(df: DataFrame, group: str, pos: str, value: Column, reach: int, out: str, width: int | None = None) -> DataFrame:
    """``value`` maximised over the rows whose position is within ``reach``. Band edges are copied over."""
    if width is None:
        return df.withColumn(out, F.max(value).over(Window.partitionBy(group).orderBy(pos).rangeBetween(-reach, reach)))
    halo = F.array_distinct(F.array(F.floor((F.col(pos) - reach) / width), F.floor((F.col(pos) + reach) / width)))
    rows = df.withColumn("_v", value).withColumn("_band", F.explode(halo))
    near = rows.withColumn(out, F.max("_v").over(Window.partitionBy(group, "_band").orderBy(pos).rangeBetween(-reach, reach)))
    return near.filter(F.col("_band") == F.floor(F.col(pos) / width)).drop("_v", "_band")
