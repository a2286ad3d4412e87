"""Keep-first, top-k per group and exact ranks that do not put one hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
#: Rows per task where each row costs much or becomes many.
DEALT_ROWS = 50_000


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def dealt(df: DataFrame, *keys: str, rows: int = DEALT_ROWS) -> DataFrame:
    """The rows dealt over tasks, at least one per core, by the hash of ``keys`` or in turn.

    A small file is read by one task, and whatever is made of its rows would stay there; the number of tasks is fixed,
    so Spark does not merge them again. ``df`` is counted, so it should be cheap.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows), *keys)


def repeated(df: DataFrame, n: str, chunk: int = DEALT_ROWS) -> DataFrame:
    """Every row as often as its ``n`` says, without that column; rows of a large count are dealt over tasks."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))
    cut = df.withColumn("_at", F.explode(parts)).withColumn("_of", F.least(F.lit(chunk).cast("long"), F.col(n) - F.col("_at") * chunk))
    shared = cut.repartition(df.sparkSession.sparkContext.defaultParallelism).withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_of"))))
    return shared.drop("_at", "_of", "_one", n)


def keep_first(df: DataFrame, key: Column | str, order: str | Sequence = "row_id") -> DataFrame:
    """First row per key. The rank filter is pushed below the shuffle, so each map task sends one row per key."""
    key = F.col(key) if isinstance(key, str) else key
    order = [order] if isinstance(order, (str, Column)) else list(order)
    w = Window.partitionBy("_key").orderBy(*order)
    ranked = df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w))
    return ranked.filter("_rn = 1").drop("_key", "_rn")


def first_k(df: DataFrame, keys: str | Sequence[str], order: Sequence, k: int, rank: str | None = None,
            salts: int = SALTS) -> DataFrame:
    """First ``k`` rows per group in two rounds: per salt, then over the survivors.

    A group of any size reaches the second round with at most ``salts * k`` rows.
    """
    keys = _names(keys)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(salts))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    cut = (df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= k)
           .drop("_salt", "_rn"))
    name = rank or "_rn"
    cut = cut.withColumn(name, F.row_number().over(outer)).filter(F.col(name) <= k)
    return cut if rank else cut.drop("_rn")


def draw(key: Column | str, seed: int = 42) -> Column:
    """Reproducible pseudo-random text of a row, uniform over its leading hex digits."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def rank_by_draw(df: DataFrame, keys: str | Sequence[str], key: str = "row_id", rank: str = "rank",
                 size: str | None = None, seed: int = 42, digits: int = 2) -> DataFrame:
    """Exact 1-based rank of each row inside its group, in ``draw`` order.

    The leading hex digits of the draw split every group into ``16 ** digits`` ordered buckets. Bucket
    counts are summed up per group, and rows are only sorted inside their bucket.
    """
    keys = _names(keys)
    rows = df.withColumn("_draw", draw(key, seed)).withColumn("_bucket", F.substring("_draw", 1, digits))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_group_size"))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_draw", key)
    ranked = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, same)
    ranked = ranked.withColumn(rank, F.col("_before") + F.col("_rn"))
    if size:
        ranked = ranked.withColumn(size, F.col("_group_size"))
    return ranked.drop("_draw", "_bucket", "_rn", "_before", "_group_size", "_b", *[f"_k{i}" for i in range(len(keys))])


def rank_by_id(df: DataFrame, keys: str | Sequence[str], key: str = "row_id", rank: str = "rank",
               buckets: int = 64) -> DataFrame:
    """Exact 1-based rank inside a group in id order, sorted only inside ranges of ids.

    The ranges are cut at measured quantiles of the ids, so sparse and hashed ids fill them evenly. The quantiles may
    be rough: ids are compared with them as they are, so they decide the balance and not the ranks.
    """
    keys = _names(keys)
    cuts = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
    rows = df.join(F.broadcast(cuts))  # one-row side
    rows = rows.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c <= F.col(key)))).drop("_cuts")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(key)
    ranked = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, same)
    return ranked.withColumn(rank, F.col("_before") + F.col("_rn")).drop(
        "_bucket", "_rn", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])
