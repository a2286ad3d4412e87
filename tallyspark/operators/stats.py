"""Corpus statistics: distributions, balance, quotas, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import text as tx
from tallyspark.operators.ordering import draw, first_k


def distributions(df: DataFrame) -> DataFrame:
    """Counts per label, per type and per label within type.

    The data is counted once by (type, label); the grouping sets run over those few rows.
    """
    counts = df.groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))
    sets = counts.groupingSets([["label"], ["type"], ["type", "label"]], "type", "label").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "type_label").when(F.col("gid") == 1, "type").otherwise("label")
    return sets.select(level.alias("level"), "type", "label", "n")


def balance_stats(df: DataFrame) -> DataFrame:
    """Median label count, target per label, income target, gap and ratio, from counts by (type, label)."""
    pairs = df.filter(F.col("type").isin(rules.RECORD_TYPES)).groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))
    return stats_from_counts(pairs)


def stats_from_counts(pairs: DataFrame) -> DataFrame:
    """Balance statistics from rows (type, label, n)."""
    kinds = pairs.agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("type") == "expense", F.col("n"))), F.lit(0)).alias("expense"),
        F.coalesce(F.sum(F.when(F.col("type") == "income", F.col("n"))), F.lit(0)).alias("income"))
    labels = pairs.filter("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("n"))
    median = labels.agg(F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)).alias("median_label_count"))
    income_target = F.floor(F.col("expense") * 0.18).cast("bigint")
    return kinds.join(F.broadcast(median)).select(  # one row on each side
        "total_rows", "expense", "income", "median_label_count",
        F.greatest(F.lit(2500), F.floor(F.col("median_label_count") * 0.85)).cast("bigint").alias("target_per_label"),
        F.round(F.col("expense") / F.greatest(F.col("income"), F.lit(1)), 2).alias("expense_income_ratio"),
        income_target.alias("income_target"),
        F.greatest(F.lit(0), income_target - F.col("income")).cast("bigint").alias("income_gap"))


def weak_labels(df: DataFrame, limit: int = 20) -> DataFrame:
    """Labels below the target, largest gap first."""
    pairs = df.filter(F.col("type").isin(rules.RECORD_TYPES)).groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))
    return weak_from_counts(pairs, limit)


def weak_from_counts(pairs: DataFrame, limit: int = 20) -> DataFrame:
    labels = pairs.filter("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("count"))
    everything = Window.partitionBy(F.lit(1))  # at most one row per label here
    median = F.percentile("count", F.lit(0.5)).over(everything)
    target = F.greatest(F.lit(2500), F.floor(median * 0.85)).cast("bigint")
    gaps = labels.select("label", "count", target.alias("target")).withColumn("gap", F.col("target") - F.col("count"))
    kind = F.when(F.col("label").isin(rules.INCOME_LABELS), "income").otherwise("expense")
    return gaps.filter("gap > 0").withColumn("type", kind).orderBy(F.desc("gap"), "label").limit(limit)


def dataset_stats(df: DataFrame, top: int = 6, weak: int = 10, threshold: int = 400) -> DataFrame:
    """Row and type counts, the largest labels and the first rare ones as ``label=count`` lists."""
    pairs = df.groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))
    kinds = pairs.agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("type") == "expense", F.col("n")).otherwise(0)).alias("expense"),
        F.sum(F.when(F.col("type") == "income", F.col("n")).otherwise(0)).alias("income"))
    labels = pairs.filter("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("n"))

    def first(rows: DataFrame, k: int, name: str) -> DataFrame:
        """The first ``k`` labels by size as one text; only they are gathered."""
        entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "label", "n")))
        text = F.transform(entries, lambda e: F.concat(e["label"], F.lit("="), e["n"].cast("string")))
        return rows.orderBy(F.desc("n"), "label").limit(k).agg(F.array_join(text, ",").alias(name))

    tops, weaks = first(labels, top, "label_top"), first(labels.filter(F.col("n") < threshold), weak, "label_weak")
    return kinds.join(F.broadcast(tops)).join(F.broadcast(weaks))  # one row on each side


def sample_rare(df: DataFrame, n: int, labels: int) -> DataFrame:
    """``n`` texts in draw order for each of the rarest labels."""
    counts = df.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    rare = counts.orderBy("_n", "label").limit(labels).select(F.col("label").alias("_rare"))
    rows = df.join(F.broadcast(rare), F.col("label") == F.col("_rare"), "left_semi")
    return first_k(rows, "label", [draw("row_id"), "row_id"], n)


def length_stats(df: DataFrame, column: str = "text", limit: int = 60) -> DataFrame:
    size = F.length(column)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(size), 4).alias("mean_length"),
                  F.count_if(size > limit).alias("over_limit"))


def quota(df: DataFrame, wanted: int) -> DataFrame:
    """How many of ``wanted`` new rows should be income and expense to keep the present ratio."""
    income = F.count_if(F.lower("type") == "income")
    rows = df.filter(F.coalesce(F.col("type"), F.lit("")) != "").agg(
        F.count(F.lit(1)).alias("rows"), income.alias("income"))
    ratio = F.when(F.col("rows") > 0, F.col("income") / F.col("rows")).otherwise(0.0)
    target = F.greatest(F.when(ratio > 0, 1).otherwise(0), F.bround(ratio * wanted).cast("bigint"))
    return rows.select("rows", "income", target.cast("bigint").alias("target_income"),
                       (F.lit(wanted) - target).cast("bigint").alias("target_expense"))


def slot_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Labelled samples and distinct classes per slot."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), tx.blank_to_null(F.col(c)).alias("value")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.field", "p.value").filter("value IS NOT NULL")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("field").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("classes"))


def corpus_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and in total; each table is counted on its own."""
    out = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
        out = part if out is None else out.unionByName(part)
    return out.groupingSets([["source"], []], "source").agg(F.sum("n").alias("n")).select(
        F.coalesce("source", F.lit("total")).alias("source"), "n")
