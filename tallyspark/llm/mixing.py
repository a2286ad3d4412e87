"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, bounded_broadcast, global_rank, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the draw that cut a source into ordered buckets; rows are only sorted inside a bucket.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: int) -> tuple[float, int]:
    """The level at which ``min(cap, weight * level)`` adds up to ``total``, and the rounds it took.

    Each round clamps the sources above their cap and deals what is left over the weights of the others. Every round
    is one aggregation that returns two sums; there are at most as many rounds as sources, in practice a handful.
    """
    level, rounds = 0.0, 0
    left, weight = total, sources.agg(F.sum("weight")).head()[0] or 0
    while weight:
        rounds += 1
        level = left / weight
        free = F.col("weight") * F.lit(level) <= F.col("cap")
        got = sources.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).head()
        rest, open_weight = total - int(got[0] or 0), int(got[1] or 0)
        if open_weight == weight:
            break
        left, weight = rest, open_weight
    return level, rounds


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source its ``source_size``, ``weight``, ``cap``, ``target`` and ``goal`` (the target in whole words).

    Weights are dealt over the sources by code point, a null source last. Targets share the total of all sizes; one
    above ``max_epochs`` times its source's size is clamped there and the excess goes to the others by weight.
    """
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").isNull(), F.col("source")]
    ranked = global_rank(by_source, order, "_rank")
    dealt = F.array(*[F.lit(int(w)) for w in weights])
    sources = written(
        ranked.withColumn("weight", dealt[(F.col("_rank") % len(weights)).cast("int")].cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs).drop("_rank"), "weighted")
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    level, _ = water_level(sources, int(total))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target).withColumn("goal", F.least(F.round("target").cast("long"), F.col("cap")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``epochs`` (whole repetitions) and the ``carry``
    columns of every row.

    A row is repeated ``floor(target / source_size)`` times. The rest of the target is filled in the order of a seeded
    draw of the ids: a row before the rest's end is taken once more, the row at its end in part, later rows not. So
    the words taken add up to the rounded target of each source. A hot source is cut into ``16 ** DIGITS`` ordered
    buckets; bucket sums are added up per source, rows only inside a bucket.

    Null text: size 0, taken 0. A null source is a source of its own, last in order. Null ids are drawn as one id.
    Repeated rows are dealt one after the other; rows of one id and size are interchangeable. A source of size 0 takes
    nothing. A text of any length counts with all its words and may be taken in part. Other columns are ignored. An empty
    table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    dealt = docs.select("doc_id", "source", key.alias("_key"), words(F.col("text")).alias("size"), draw.alias("_draw"),
                        F.substring(draw, 1, DIGITS).alias("_bucket"), F.struct(F.lit(0), *carry).alias("_carried"))
    sizes = written(dealt.drop("_carried"), "sizes")
    targets = written(source_targets(sizes, weights, max_epochs), "targets")
    targets = targets.select(key.alias("_key"), "source_size", "target", "goal")

    buckets = sizes.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = written(buckets.select(
        "_key", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before")), "buckets")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (dealt if carry else sizes).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(buckets, ["_key", "_bucket"]).join(bounded_broadcast(targets), "_key")
    whole = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0))
    rest = F.col("goal") - F.col("_whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_inside")))
    return rows.withColumn("_whole", whole).select(
        "doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + part).cast("long").alias("taken"),
        F.col("_whole").cast("long").alias("epochs"), *[F.col("_carried")[c].alias(c) for c in carry])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    return F.regexp_substr(text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+")))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of a ``mix`` that carries ``text``, as often as they are taken, a part as its first words."""
    whole = F.col("taken") - F.col("taken") % F.greatest(F.col("size"), F.lit(1))
    part = (F.col("taken") - whole).alias("_part")
    rows = mixed.filter("taken > 0").withColumn("_part", part).withColumn("_copy", F.explode(
        F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    cut = (F.col("_part") > 0) & (F.col("_copy") * F.col("size") > F.col("taken"))
    return rows.withColumn("text", F.when(cut, first_words(F.col("text"), F.col("_part"))).otherwise(F.col("text"))).drop("_part", "_copy")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, CAST(([5, 2, 1])[1 + CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INTEGER)] AS BIGINT) AS weight,
                  3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
     c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left,
                  row_number() OVER (ORDER BY cap / weight, source IS NULL, encode(source)) AS place FROM w
           WINDOW o AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     l AS (SELECT CAST(total - cap_before AS DOUBLE) / weight_left AS level FROM c
           WHERE (total - cap_before) / weight_left * weight <= cap ORDER BY place LIMIT 1),
     t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target,
                  least(CAST(round(least(CAST(cap AS DOUBLE), weight * level)) AS BIGINT), cap) AS goal FROM c, l),
     p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.goal,
                  CASE WHEN t.source_size > 0 THEN t.goal // t.source_size ELSE 0 END AS epochs,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id, d.size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, goal - epochs * source_size - before)) AS BIGINT) AS taken, epochs FROM p
"""
