"""Exact dedup by skew-safe combining: local, then salted, then global, with the whole content as part of every key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE

SALTS = 16
#: Width of the id part of a packed rank: 10 ** 20 exceeds 2 ** 64.
_IDS = "100000000000000000000"
_HALF = "9223372036854775808"


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _packed(length: Column, doc_id: Column) -> Column:
    """One decimal whose maximum is the longest original, then the smallest id; a null id comes last.

    A decimal stays in the hash aggregate's buffer, so texts are hashed and not sorted.
    """
    place = F.coalesce(doc_id.cast("decimal(20,0)") + F.expr(f"{_HALF}BD"), F.expr("18446744073709551616BD"))
    return (length.cast("decimal(10,0)") * F.expr(f"{_IDS}BD") + F.expr("99999999999999999999BD") - place).cast("decimal(33,0)")


def _unpacked_id(rank: Column) -> Column:
    place = F.expr("99999999999999999999BD") - (rank % F.expr(f"{_IDS}BD"))
    return F.when(place < F.expr("18446744073709551616BD"), place - F.expr(f"{_HALF}BD")).cast("long")


def winners(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per distinct content: ``content``, ``keep_id``, ``group_size``.

    1. Local: each map task combines its rows by (digest, salt, content); the salt is the task's number, so a group
       leaves a task as one row.
    2. Salted: a digest's rows meet in ``salts`` groups.
    3. Global: one row per salt and content meets per (digest, content).

    Groups compare the content itself, so texts whose digests agree by chance stay apart.
    """
    digest = digest or (lambda content: F.unhex(F.sha2(content, 256)))
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.length(F.coalesce("text", F.lit(""))).alias("_n"), normalised(F.col("text")).alias("content"))
    rows = rows.select(
        digest(F.col("content")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "content",
        _packed(F.col("_n"), F.col("_id")).alias("rank"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    return whole.select("content", _unpacked_id(F.col("rank")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with the row of its content that stays.

    Returns ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Texts are equal if they agree without
    ASCII white space; the longest original stays, then the smallest id.

    Null or blank text: empty content, one group. Null ids lose ties and get ``keep_id`` null only if all ids of the
    group are null; ``kept`` compares null-safely. Repeated rows of the winner's id are all marked kept, ``winners``
    has one row for them. A text of any length is compared whole; its content travels as one value. Other columns are
    ignored. An empty table gives an empty result.
    """
    best = winners(docs, salts, digest).select(F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return rows.join(best, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
