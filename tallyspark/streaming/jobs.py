"""Structured Streaming jobs (ST1-ST9). Each shares its row logic with the batch operators.

Results go to files below the shared checkpoint folder. Batches write to their own ``batch=N`` folder, so a batch
that is run again after a failure replaces itself.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tallyspark.functions import text as tx
from tallyspark.operators.dedupe import append_new, merge_feedback
from tallyspark.session import scratch
from tallyspark.sources import io
from tallyspark.streaming.buckets import BUCKET_ROWS, BucketStore
from tallyspark.views import FEEDBACK

# Workers need not have the package installed: the state processor travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Parquet files of one table as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction log stream with event time ``at``."""
    log = spark.sql(FEEDBACK, events=file_stream(spark, folder, "events"))
    return log.withColumn("at", F.col("ts").cast("timestamp"))


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end of the available data in append mode and read the result."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/_state").trigger(
        availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_batches(stream: DataFrame, name: str, step: Callable[[DataFrame, int], None], mode: str = "append", state: str | None = None) -> None:
    """Run ``step`` per batch to the end of the available data; with ``state`` a later call goes on after the last batch."""
    path = state or scratch(stream.sparkSession, name)
    query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()


# --- ST1-ST3: feedback ------------------------------------------------------------------------------
def intake(log: DataFrame, horizon: str = "60 days") -> DataFrame:
    """Usable dislikes, one per text inside the horizon (the batch form remembers every text)."""
    key = F.lower(tx.strip(F.col("text_input")))
    rows = log.filter("log_type = 'dislike'").withColumn("text_key", key).filter("text_key <> ''")
    return rows.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["text_key"]).select("text_key")


def apply_corrections(corpus: DataFrame, stream: DataFrame, schema: str, path: str | None = None, limit: int = BUCKET_ROWS) -> DataFrame:
    """Each batch merges its corrections into the buckets of the corpus that hold their texts.

    The corpus lies in hash buckets by text; batch n turns version n into n + 1 and rewrites only the buckets that its
    texts fall into. The first dislike of a text counts, in whatever batch it comes: keys of earlier batches are kept in a
    second table of buckets. With a ``path`` of the caller's the job resumes; a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "corpus")
    text_key, log_key = F.lower(tx.strip(F.col("text"))), F.lower(tx.strip(F.col("text_input")))
    table = BucketStore(spark, f"{path}/corpus", schema, text_key, F.col("row_id"), limit)
    seen = BucketStore(spark, f"{path}/seen", "_k STRING", F.col("_k"), limit=limit)
    table.create(corpus)
    seen.create(spark.createDataFrame([], "_k STRING"))

    def step(batch: DataFrame, number: int) -> None:
        keyed = batch.filter("log_type = 'dislike'").withColumn("_k", log_key).filter("_k <> ''").persist()
        try:
            looked, places = seen.touched(number, keyed, F.col("_k")), table.touched(number, keyed, F.col("_k"))
            fresh = keyed.join(seen.rows(number, looked), "_k", "left_anti").drop("_k")
            table.update(number, places, lambda rows: merge_feedback(rows, fresh).drop("op"))
            seen.update(number, looked, lambda rows: rows.union(keyed.select("_k")).distinct())
        finally:
            keyed.unpersist()

    run_batches(stream, "corrections", step, state=f"{path}/_state")
    return table.rows(table.latest())


def append_stream(stream: DataFrame, schema: str, path: str | None = None, limit: int = BUCKET_ROWS) -> DataFrame:
    """Each batch appends only texts the sink does not hold; with a ``path`` of the caller's the job resumes.

    Which texts it holds is asked of an index in hash buckets, of which a batch reads and rewrites only those that its
    texts fall into; the sink itself is written and not read.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "sink")
    index = BucketStore(spark, f"{path}/index", "text STRING", F.col("text"), limit=limit)
    index.create(spark.createDataFrame([], "text STRING"))

    def step(batch: DataFrame, number: int) -> None:
        keys = batch.select(tx.strip(F.col("text")).alias("text")).filter("text <> ''").distinct()
        looked = index.touched(number, keys, F.col("text"))
        held = index.rows(number, looked)
        append_new(held, batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        index.update(number, looked, lambda rows: rows.union(keys).distinct())

    run_batches(stream, "append", step, state=f"{path}/_state")
    if not io.exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch INT").parquet(f"{path}/rows").drop("batch")


# --- ST4-ST8: windows -------------------------------------------------------------------------------
def latest_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts: changed keys per batch, the last value per key wins."""
    spark = stream.sparkSession
    path = scratch(spark, "counts")
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(counts, "label-counts", step, "update")
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by("n", "number").alias("n"))


def daily_spend(stream: DataFrame, delay: str = "2 days", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Sum and rows per user and window; late rows within the delay still count."""
    frame = F.window("at", width, slide) if slide else F.window("at", width)
    return stream.withWatermark("at", delay).groupBy("user_id", frame.alias("w")).agg(
        F.sum(F.bround(F.col("amount") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("n"))


def frequent_categories(stream: DataFrame, delay: str = "2 days", more_than: int = 3) -> DataFrame:
    """Categories a user bought more than so many times within seven days."""
    counts = stream.withWatermark("at", delay).groupBy("user_id", "category", F.window("at", "7 days", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > more_than)


def rolling_quality(stream: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Rows, mean and approximate 95th percentile of the latency, and hit rate, per backend and window."""
    return stream.withWatermark("at", delay).groupBy("backend", F.window("at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_ms"), F.percentile_approx("latency_ms", 0.95).alias("p95_ms"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def chat_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Turns of a user without a pause longer than ``gap``."""
    return stream.withWatermark("at", delay).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns"))


# --- ST9: alert state -------------------------------------------------------------------------------
class FirstCrossing(StatefulProcessor):
    """Running spend per user; one alert when it first passes the budget."""

    def __init__(self, budget: float):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", StructType([StructField("spent", DoubleType()), StructField("told", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        spent, told = self.state.get() if self.state.exists() else (0.0, False)
        spent += sum(float(chunk["amount"].sum()) for chunk in rows)
        crossed = not told and spent > self.budget
        self.state.update((spent, told or crossed))
        if crossed:
            yield pd.DataFrame({"user_id": [key[0]]})

    def close(self) -> None:
        return None


def budget_alerts(stream: DataFrame, budget: float) -> DataFrame:
    """Users whose spend passes ``budget``, each once."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.select("user_id", "amount").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=FirstCrossing(budget), outputStructType=StructType([StructField("user_id", LongType())]),
        outputMode="Append", timeMode="None")
