"""Helpers that several operators share: the documents table, written intermediate tables, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import scratch

#: White space of the word and equality rules, and the word pattern that goes with it.
SPACE = "\t\n\x0b\f\r "
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of groups that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written below the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``rows`` rows; beyond that Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partition_offsets(df: DataFrame, part: str, value: str) -> DataFrame:
    """Per value of ``part`` (a partition number) the sum of ``value`` in all lower ones, as ``offset``.

    One row per partition of the input, so the single-task window below sees a few thousand rows at any data size.
    """
    totals = df.groupBy(part).agg(F.sum(value).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("offset"))


def global_rank(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """0-based rank of every row in a total order: range partitions, ranks inside each, offsets of partition counts.

    ``df`` must be cheap to evaluate twice or written, and its rows distinct in ``order``.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    offsets = partition_offsets(dealt.withColumn("_one", F.lit(1)), "_part", "_one")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_inside") + F.col("offset")).cast("long")).drop("_part", "_inside", "offset"))
