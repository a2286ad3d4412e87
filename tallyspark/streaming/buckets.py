"""Tables in hash buckets with numbered versions, for jobs that change few rows per batch."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import io

#: Rows of a bucket beyond which it is split when it is written next.
BUCKET_ROWS = 1_000_000
#: Bits of the hash that buckets may use; rows of one key cannot be told apart by more.
MAX_BITS = 48
_MANIFEST = "bucket STRING, version INT, rows BIGINT"


class BucketStore:
    """Rows below ``path`` in buckets named by the leading bits of the hash of their ``key``.

    Version n is a manifest with one row per bucket: the version that wrote its files and how many rows they hold. An
    update reads and writes only buckets that its keys fall into and takes over the others' entries, so neither reading
    nor writing grows with the table, only with the batch: a bucket that has grown past ``limit`` rows is split by more
    bits when it is written next. Files of a version are written first and its manifest last; the mark that Spark leaves
    in a finished folder publishes it at once. A repeated update of a published version does nothing, one of an
    unpublished version replaces what was written. Manifests have about one row per ``limit`` rows of the table.

    Rows whose key is null are never looked up and are dealt by ``spread``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Column, spread: Column | None = None, limit: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.schema, self.limit = spark, path, schema, limit
        self.key = F.xxhash64(key) if spread is None else F.coalesce(F.nullif(F.xxhash64(key), F.xxhash64(F.lit(None).cast("string"))), F.xxhash64(spread, F.lit(1)))

    def latest(self) -> int | None:
        """Highest published version, None before the first."""
        names = io.names(self.spark, f"{self.path}/manifest")
        done = [int(n[1:]) for n in names if n.startswith("v") and io.exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        return max(done, default=None)

    def manifest(self, version: int) -> dict[str, tuple[int | None, int]]:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v{version}").collect()
        return {r.bucket: (r.version, r.rows) for r in rows}

    def files(self, version: int, buckets: list[str] | None = None) -> list[str]:
        """Folders that hold the rows of a version, or of some of its buckets."""
        return [f"{self.path}/data/v{v}/bucket={b}" for b, (v, _) in self.manifest(version).items() if v is not None and (buckets is None or b in buckets)]

    def rows(self, version: int, buckets: list[str] | None = None) -> DataFrame:
        paths = self.files(version, buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, version: int, keys: DataFrame, key: Column) -> list[str]:
        """Buckets that keys fall into; at most one name per bucket comes to the driver."""
        found = _located(keys.select(_bits(F.xxhash64(key)).alias("_bits")).distinct(), list(self.manifest(version)))
        return sorted(r.bucket for r in found.select("bucket").distinct().collect())

    def create(self, rows: DataFrame) -> None:
        """Version 0 from whole rows, unless there is one."""
        if self.latest() is not None:
            return
        n = rows.count()
        bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, n) / self.limit))))
        self._write(0, rows, ["b" + format(k, f"0{bits}b") if bits else "b" for k in range(2 ** bits)], {})

    def update(self, version: int, buckets: list[str], merge: Callable[[DataFrame], DataFrame]) -> None:
        """Version ``version + 1``: the rows of ``buckets`` replaced by what ``merge`` makes of them."""
        if io.exists(self.spark, f"{self.path}/manifest/v{version + 1}/_SUCCESS"):
            return
        before = self.manifest(version)
        kept = {b: entry for b, entry in before.items() if b not in set(buckets)}
        self._write(version + 1, merge(self.rows(version, buckets)), [n for b in buckets for n in self._split(b, before[b][1])], kept)

    def _split(self, bucket: str, rows: int) -> list[str]:
        more = max(0, math.ceil(math.log2(max(1, rows) / self.limit)))
        more = min(more, max(0, MAX_BITS - len(bucket) + 1))
        return [bucket + format(k, f"0{more}b") for k in range(2 ** more)] if more else [bucket]

    def _write(self, version: int, rows: DataFrame, buckets: list[str], kept: dict[str, tuple[int | None, int]]) -> None:
        target, written = f"{self.path}/data/v{version}", {}
        if buckets:
            placed = _located(rows.withColumn("_bits", _bits(self.key)), buckets).drop("_bits")
            placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
            held = self.spark.read.schema(f"{self.schema}, bucket STRING").parquet(target).groupBy("bucket").count().collect()
            written = {r["bucket"]: (version, r["count"]) for r in held}
        entries = [(b, *entry) for b, entry in (kept | {b: (None, 0) for b in buckets} | written).items()]
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")


def _bits(number: Column) -> Column:
    return F.concat(F.lit("b"), F.lpad(F.bin(number), 64, "0"))


def _located(rows: DataFrame, buckets: list[str]) -> DataFrame:
    """Rows with the bucket whose name begins their ``_bits``; no name begins another one."""
    lengths = sorted({len(b) for b in buckets})
    if len(lengths) == 1:
        return rows.withColumn("bucket", F.substring("_bits", 1, lengths[0]))
    names = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket STRING")
    choices = reduce(lambda a, n: [*a, F.substring("_bits", 1, n)], lengths, [])
    return rows.withColumn("bucket", F.explode(F.array(*choices))).join(F.broadcast(names), "bucket")  # one row per bucket
