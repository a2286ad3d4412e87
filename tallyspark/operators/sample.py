"""Samples, splits, caps, quotas (K1-K15). All draws are functions of the row key, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.ordering import draw, first_k, rank_by_draw, rank_by_id


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_mismatches(pairs: DataFrame, k: int = 5) -> DataFrame:
    return pairs.filter(F.lower("label_true") != F.lower("label_pred")).orderBy("row_id").limit(k)


def head_per_source(df: DataFrame, source: str, k: int = 100) -> DataFrame:
    """First rows with non-empty fields of each source."""
    rows = df.filter((F.coalesce("text", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != ""))
    return first_k(rows, source, ["row_id"], k)


def cap_per_label(df: DataFrame, label: str, cap: int) -> DataFrame:
    """At most ``cap`` rows per label in draw order (a sampling rule of the training sets)."""
    return first_k(df, label, [draw("row_id"), "row_id"], cap)


def global_cap(df: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows in draw order; ranks are exact at any cap and no task sorts all rows."""
    ranked = rank_by_draw(df.withColumn("_all", F.lit(1)), "_all", rank="_rank")
    return ranked.filter(F.col("_rank") <= cap).drop("_all", "_rank")


def subsample_by_label(df: DataFrame, label: str, max_rows: int) -> DataFrame:
    """An equal share of ``max_rows`` for every label, everything if the table is small enough."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    share = counts.filter(F.col(label).isNotNull()).agg(F.sum("_c").alias("_total"), F.count(F.lit(1)).alias("_labels"))
    ranked = rank_by_draw(df, label, rank="_rank").join(F.broadcast(share))  # one-row side
    per = F.greatest(F.lit(1), F.floor(F.lit(max_rows) / F.col("_labels")))
    kept = ranked.filter((F.col("_total") <= max_rows) | (F.col("_rank") <= per)).drop("_rank", "_total", "_labels")
    return global_cap(kept, max_rows)


def oversample(df: DataFrame, column: str, value: str, target: Column) -> DataFrame:
    """Copies of the rows of one class until the class has ``target`` rows.

    ``target`` may use ``_class`` (present size) and ``_all`` (size per value map, see ``class_counts``). Every row
    is copied equally often; the remainder goes to the rows first in draw order.
    """
    is_class = F.col(column) == value
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.map_from_entries(F.collect_list(F.struct(column, "_n"))).alias("_sizes"))
    ranked = rank_by_draw(df.filter(is_class), column, rank="_rank", size="_class").join(F.broadcast(sizes))
    goal = F.greatest(target, F.col("_class"))
    copies = F.floor(goal / F.col("_class")) + F.when(F.col("_rank") <= goal % F.col("_class"), 1).otherwise(0)
    grown = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_rank", "_class", "_sizes")
    return df.filter(~is_class).withColumn("copy", F.lit(1)).unionByName(grown)


def stratified_split(df: DataFrame, label: str, share: float = 0.8) -> DataFrame:
    """``split`` = train for the first ``share`` of each label in draw order, else test."""
    ranked = rank_by_draw(df, label, rank="_rank", size="_size")
    train = F.col("_rank") <= F.floor(F.col("_size") * share + 0.5)
    return ranked.withColumn("split", F.when(train, "train").otherwise("test")).drop("_rank", "_size")


def key_split(df: DataFrame, key: str, test_percent: int) -> DataFrame:
    """Split by the key alone, stable when rows are added. No shuffle."""
    bucket = F.conv(F.substring(draw(key), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(bucket < test_percent, "test").otherwise("train"))


def fixed_sample(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    return df.orderBy(draw(key), key).limit(n)


def replicate(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def scale_quotas(quotas: DataFrame, total: int) -> DataFrame:
    """Quotas (key, pos, quota) scaled to ``total``; every key gets at least 1 and the last the remainder."""
    order = Window.partitionBy(F.lit(1)).orderBy("pos")  # one row per quota key
    whole = Window.partitionBy(F.lit(1))
    n = F.greatest(F.lit(1), F.bround(F.col("quota") * total / F.sum("quota").over(whole)).cast("bigint"))
    rows = quotas.withColumn("_n", n).withColumn("_last", F.col("pos") == F.max("pos").over(whole)).withColumn(
        "_count", F.count(F.lit(1)).over(whole)).withColumn("_i", F.row_number().over(order))
    rest = F.greatest(F.lit(0), F.lit(total) - F.sum(F.when(~F.col("_last"), F.col("_n")).otherwise(0)).over(whole))
    few = F.when(F.col("_i") <= total, 1).otherwise(0)
    value = F.when(F.col("_count") >= total, few).otherwise(F.when(F.col("_last"), rest).otherwise(F.col("_n")))
    return rows.select("key", "pos", value.cast("bigint").alias("quota"))


def fill_to_quota(df: DataFrame, quotas: DataFrame, key: str) -> DataFrame:
    """Rows in id order up to the quota of their group; ``quotas`` has (key, quota), one row per group."""
    ranked = rank_by_id(df, key, rank="_rank")
    limits = quotas.select(F.col("key").alias("_key"), F.col("quota").alias("_quota"))
    return ranked.join(limits, F.col(key) == F.col("_key")).filter("_rank <= _quota").drop("_rank", "_key", "_quota")


def shuffle(df: DataFrame, seed: int = 42, key: str = "row_id") -> DataFrame:
    return df.withColumn("draw", draw(key, seed)).orderBy("draw", key)
