"""Models on Spark ML (M1-M4) and routing by confidence (M7)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators.ordering import dealt, repeated
from tallyspark.session import kept

# Model parameters are bounded by vocabulary size x classes, whatever the number of rows.


def ngrams(tokens: Column, upto: int = 3) -> Column:
    """Word n-grams of 1..``upto`` words."""
    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(1, upto + 1)])


def ngram_idf(df: DataFrame, key: str, text: Column, top: int) -> DataFrame:
    """The ``top`` most frequent n-grams with document frequency and smoothed idf."""
    rows = df.select(key, tx.ascii_tokens(text).alias("_w"))
    terms = rows.select(key, F.explode(ngrams(F.col("_w"))).alias("term"))
    per_doc = terms.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    stats = per_doc.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    kept = stats.orderBy(F.desc("tf"), "term").limit(top).join(F.broadcast(total))  # one-row side
    return kept.select("term", "tf", "df", F.round(F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0, 6).alias("idf"))


def feature_stages(vocabulary: int) -> list:
    return [CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary), IDF(inputCol="tf", outputCol="tfidf"),
            Normalizer(inputCol="tfidf", outputCol="features")]


def with_grams(df: DataFrame, text: Column) -> DataFrame:
    rows = tx.let(df, _w=tx.letter_tokens(text))
    return rows.withColumn("grams", ngrams(F.col("_w"))).drop("_w")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * class size)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(F.lit(1))  # one row per class
    weights = counts.select(label, (F.sum("_c").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # as many rows as classes


def fit_text_classifier(df: DataFrame, text: Column, label: str, vocabulary: int, linear_svm: bool = False, iterations: int = 20) -> PipelineModel:
    """TF-IDF of 1-3 grams into a balanced linear classifier.

    Grams are made once per different text and label and written; the fits see them as often as there are rows.
    """
    texts = kept(df.select(label, text.alias("_t")).groupBy(label, "_t").agg(F.count(F.lit(1)).alias("_n")), "texts")
    made = kept(with_grams(dealt(texts), F.col("_t")).drop("_t"), "grams")
    rows = class_weights(repeated(made, "_n"), label)
    if linear_svm:
        base = LinearSVC(maxIter=iterations, weightCol="weight")
        model = OneVsRest(classifier=base, labelCol="y", featuresCol="features", weightCol="weight")
    else:
        model = LogisticRegression(maxIter=iterations, labelCol="y", featuresCol="features", weightCol="weight")
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, *feature_stages(vocabulary), model]).fit(rows)


def labels_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels


def predict(model: PipelineModel, df: DataFrame, text: Column, out: str = "label_pred") -> DataFrame:
    """Predicted label, confidence and distribution where the model has one."""
    labels = F.array(*map(F.lit, labels_of(model)))
    stages = [s for s in model.stages if not isinstance(s, StringIndexerModel)]
    scored = PipelineModel(stages).transform(with_grams(df, text))
    rows = scored.withColumn(out, F.get(labels, F.col("prediction").cast("int")))
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        rows = rows.withColumn("confidence", F.round(F.array_max(p), 4)).withColumn(
            "distribution", F.map_from_arrays(labels, F.transform(p, lambda x: F.round(x, 4))))
    else:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    return rows.drop("grams", "tf", "tfidf", "features", "rawPrediction", "probability", "prediction")


def review_route(df: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Low or missing confidence goes to review."""
    low = F.coalesce(F.col("confidence") < threshold, F.lit(True))
    return df.withColumn("route", F.when(low, "review").otherwise("accept"))
