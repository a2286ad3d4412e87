"""Columns that depend on a text only, computed once per distinct text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import kept

#: Distinct texts, and their bytes, that may be broadcast with what was computed for them. With more of either, every
#: row is computed on its own: it decides the cost, not the result.
MAX_TEXTS = 500_000
MAX_BYTES = 32 << 20


def per_text(df: DataFrame, columns: Sequence[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``derive(df)``, which adds columns that depend on the text ``columns`` alone.

    ``df`` is read twice, so it should be cheap or written. The join leaves its rows where they are.
    """
    texts = kept(df.select(*columns).distinct(), "texts")
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.concat_ws("", *columns))), F.lit(0))).first()
    if n > MAX_TEXTS or size > MAX_BYTES:
        return derive(df)
    found = kept(derive(texts.repartition(df.sparkSession.sparkContext.defaultParallelism)), "by-text")
    names = {c: f"_of_{c}" for c in columns}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()])
    return df.join(F.broadcast(found.withColumnsRenamed(names)), same).drop(*names.values())
