"""Lookup of a user's corrections by equal or similar text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators.ml import ngrams

#: Scores are compared to this many digits, so that the order of summation decides nothing.
DIGITS = 9


@dataclass
class GramWeights:
    """Inverse document frequencies of the 1-3 grams of a corpus, and the weight of a gram it does not hold."""

    table: DataFrame
    unknown: float


def normal_text(text: Column) -> Column:
    """Words of the cleaned text, separated by single blanks."""
    return F.array_join(tx.letter_tokens(tx.clean_category_text(text)), " ")


def _grams(words: Column, upto: int) -> Column:
    return ngrams(F.filter(F.split(words, " "), lambda w: w != ""), upto)


def gram_weights(corpus: DataFrame, text: Column, upto: int = 3) -> GramWeights:
    """Weights from a whole corpus; one row per gram, so the table stays distributed."""
    n = corpus.count()
    terms = corpus.select(F.explode(F.array_distinct(_grams(normal_text(text), upto))).alias("term"))
    idf = (F.log((1.0 + F.lit(n)) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf")
    unknown = corpus.sparkSession.range(1).select(F.log(F.lit(1.0 + n)) + 1.0).head()[0]
    return GramWeights(terms.groupBy("term").agg(idf), float(unknown))


def unit_vectors(texts: DataFrame, weights: GramWeights, upto: int = 3) -> DataFrame:
    """``words``, ``term``, ``x`` of distinct texts. A gram the corpus does not hold weighs most and counts in the norm."""
    terms = texts.select("words", F.explode(_grams(F.col("words"), upto)).alias("term")).groupBy("words", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.join(weights.table, "term", "left").withColumn("_x", F.col("tf") * F.coalesce("idf", F.lit(weights.unknown)))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy("words")))  # the grams of one text
    return weighed.select("words", "term", (F.col("_x") / norm).alias("x"))


def similar_corrections(log: DataFrame, corrections: DataFrame, weights: GramWeights, threshold: float = 0.85) -> DataFrame:
    """``row_id``, ``correction_id``, ``match_type``, ``score``: the correction of the same user that a text takes.

    A correction whose lower-case text equals the cleaned text is taken first. Else the one of highest cosine counts if
    that reaches ``threshold``; of equal ones the smallest id. Texts meet on the heaviest grams of the correction: with
    vectors of length one, what two texts share outside these adds at most the norm of the correction's other grams,
    and a gram is among the heaviest as long as that norm has not fallen below the threshold, so a pair without a common
    heavy gram stays below it whatever the other text holds. Every distinct text is weighed once, and a pair of
    texts is compared once for all users and rows that have it.
    """
    asked = log.select("row_id", "user_id", F.lower(tx.clean_category_text(F.col("text"))).alias("clean"), normal_text(F.col("text")).alias("words"))
    given = corrections.select("correction_id", "user_id", F.lower(tx.strip(F.col("text"))).alias("clean"), normal_text(F.col("text")).alias("words"))
    first = given.filter("clean <> ''").groupBy("user_id", "clean").agg(F.min("correction_id").alias("correction_id"))
    met = asked.join(first, ["user_id", "clean"], "left")
    exact = met.filter("correction_id IS NOT NULL").select("row_id", "correction_id", F.lit("exact").alias("match_type"), F.lit(1.0).alias("score"))

    rest = met.filter("correction_id IS NULL AND words <> ''").select("row_id", "user_id", "words")
    left = rest.select("user_id", "words").distinct()
    right = given.filter("words <> ''").groupBy("user_id", "words").agg(F.min("correction_id").alias("correction_id"))
    vectors = unit_vectors(left.select("words").union(right.select("words")).distinct(), weights)
    heavy = Window.partitionBy("words").orderBy(F.desc("x"), "term").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col("x") * F.col("x")).over(heavy), F.lit(0.0))
    prefix = vectors.withColumn("_spent", spent).filter(1.0 - F.col("_spent") >= threshold * threshold - 1e-9).select("words", "term")
    offered = right.join(prefix, "words").select("user_id", "term", F.col("words").alias("fix"), "correction_id")
    met = left.join(vectors.select("words", "term"), "words").join(offered, ["user_id", "term"]).select("user_id", "words", "fix", "correction_id").distinct()
    dots = met.select("words", "fix").distinct().join(vectors.select(F.col("words").alias("fix"), "term", F.col("x").alias("_y")), "fix").join(
        vectors, ["words", "term"])
    scores = dots.groupBy("words", "fix").agg(F.round(F.sum(F.col("x") * F.col("_y")), DIGITS).alias("score")).filter(F.col("score") >= threshold)
    best = met.join(scores, ["words", "fix"]).groupBy("user_id", "words").agg(
        F.max(F.struct("score", (-F.col("correction_id")).alias("c"))).alias("b"))
    similar = rest.join(best, ["user_id", "words"]).select(
        "row_id", (-F.col("b.c")).alias("correction_id"), F.lit("similarity").alias("match_type"), F.col("b.score").alias("score"))
    return exact.unionByName(similar)
