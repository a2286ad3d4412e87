"""Running sums and many-to-one joins that do not put a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import written

#: A key with more than this part of all rows is joined by broadcast; there are fewer such keys than the number says.
HOT_SHARE = 512


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with inclusive running sums per ``key`` (not null) in ``order``, written.

    Rows are dealt by ranges of (key, order), so a hot key spreads over many tasks. Sums run inside each part; what a
    key carries over from earlier parts is added from a table with the sums per part of the keys that cross a border.
    There is at most one such key per border, so that table is bounded by the number of parts and is broadcast.
    ``df`` must be cheap to evaluate twice or written; rows that agree in the whole order stay in one part.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()])
    dealt = written(dealt.repartitionByRange(parts, F.col(key), *order).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    crossing = totals.select(F.col("high").alias(key)).distinct()  # a row per part at most
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.join(F.broadcast(crossing), key, "left_semi").groupBy(key, "_part").agg(
        *[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    carried = written(carried.select(key, "_part", *[F.sum(f"_v_{n}").over(before).alias(f"_c_{n}") for n in sums]), f"{name}-carried")
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(F.broadcast(carried), [key, "_part"], "left")
    total = {n: F.col(f"_s_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    return written(out.select(*df.columns, *[v.alias(n) for n, v in total.items()]), name)


def to_one(rows: DataFrame, table: DataFrame, on: list[str], weight: Column, total: int, how: str = "left") -> DataFrame:
    """Join of ``rows`` to ``table`` (one row per key) where a key may hold a large part of ``rows``.

    ``weight`` over ``table`` says how many rows a key has, ``total`` how many there are in all. Keys with more than one
    in ``HOT_SHARE`` of them, of which there are fewer than ``HOT_SHARE``, are broadcast and their rows stay where they
    are; the rest meets by a shuffle. Both inputs should be written. ``how`` is left or inner; key columns are not null.
    """
    hot = table.filter(weight * HOT_SHARE > total)
    cold = table.filter(weight * HOT_SHARE <= total)
    columns = [*rows.columns, *[c for c in table.columns if c not in on]]
    near = rows.join(F.broadcast(hot), on).select(*columns)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how).select(*columns)
    return near.unionByName(far)
