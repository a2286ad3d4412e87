"""Linear classifier over embeddings with one sigmoid per class, fitted on held-out margins (M5)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.ml import class_weights

_CURVES = "fold INT, k INT, slope DOUBLE, shift DOUBLE, label STRING"


@dataclass
class CalibratedModel:
    """One linear model per fold, each with a sigmoid (slope, shift) per class; the probabilities are their mean."""

    labels: list
    models: list[LogisticRegressionModel]
    curves: list[list[tuple[float, float]]]

    def score(self, rows: DataFrame, vector: str = "embedding", out: str = "label_pred") -> DataFrame:
        """Rows with the likeliest label, its probability and the distribution; any rows with the vector will do."""
        scored = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
        parts = []
        for n, (model, curves) in enumerate(zip(self.models, self.curves, strict=True)):
            scored = _margins(model, scored, f"_m{n}")
            slopes, shifts = (F.array(*[F.lit(c[i]) for c in curves]) for i in (0, 1))
            raw = F.zip_with(F.zip_with(f"_m{n}", slopes, lambda m, a: m * a), shifts, lambda x, b: 1.0 / (1.0 + F.exp(-(x + b))))
            scored = scored.withColumn(f"_p{n}", raw)
            parts.append(_shares(f"_p{n}", len(self.labels)))
        summed = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
        scored = scored.withColumn("_p", F.transform(summed, lambda x: x / len(parts)))
        labels = F.array(*map(F.lit, self.labels))
        best = F.array_max("_p")
        return scored.select(*rows.columns, F.get(labels, (F.array_position("_p", best) - 1).cast("int")).alias(out), best.alias("confidence"),
                             F.map_from_arrays(labels, "_p").alias("distribution"))

    def save(self, spark: SparkSession, path: str) -> None:
        for n, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/fold{n}")
        rows = [(n, k, *self.curves[n][k], str(self.labels[k])) for n in range(len(self.models)) for k in range(len(self.labels))]
        spark.createDataFrame(rows, _CURVES).coalesce(1).write.mode("overwrite").parquet(f"{path}/curves")

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: type = str) -> CalibratedModel:
        rows = sorted(spark.read.schema(_CURVES).parquet(f"{path}/curves").collect())
        folds = max(r.fold for r in rows) + 1
        curves = [[(r.slope, r.shift) for r in rows if r.fold == n] for n in range(folds)]
        return cls([kind(r.label) for r in rows if r.fold == 0], [LogisticRegressionModel.load(f"{path}/fold{n}") for n in range(folds)], curves)


def _shares(name: str, n: int) -> Column:
    """Numbers that add up to one."""
    total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    return F.transform(name, lambda x: F.when(total > 0, x / total).otherwise(1.0 / n))


def _margins(model: LogisticRegressionModel, rows: DataFrame, out: str) -> DataFrame:
    model.setFeaturesCol("_v").setPredictionCol("_l").setRawPredictionCol("_r").setProbabilityCol("_q")
    return model.transform(rows).withColumn(out, vector_to_array("_r")).drop("_l", "_r", "_q")


def _fold(key: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(folds)).cast("int")


def fit_sigmoids(held: DataFrame, classes: int, folds: int, rounds: int = 40) -> list[list[tuple[float, float]]]:
    """Slope and shift per fold and class from rows of ``fold``, ``y`` (class number) and ``margin`` (one per class).

    Each class is one against all others, with targets drawn in by one row of either kind. Newton steps for all of
    them share one pass: a round is one aggregation that brings five sums per fold and class to the driver. A step that
    does not lower the loss is halved.
    """
    sizes = {(r.fold, r.y): r["count"] for r in held.groupBy("fold", "y").count().collect()}
    keys = [(f, k) for f in range(folds) for k in range(classes)]
    whole = {f: sum(n for (g, _), n in sizes.items() if g == f) for f in range(folds)}
    positive = {(f, k): sizes.get((f, k), 0) for f, k in keys}
    high = {key: (positive[key] + 1) / (positive[key] + 2) for key in keys}
    low = {(f, k): 1 / (whole[f] - positive[f, k] + 2) for f, k in keys}
    at = {(f, k): (0.0, math.log((positive[f, k] + 1) / (whole[f] - positive[f, k] + 1))) for f, k in keys}
    last, step, done = {}, dict.fromkeys(keys, (0.0, 0.0)), set()
    flat = held.select("fold", "y", F.posexplode("margin").alias("k", "m"))

    def value(of: dict) -> Column:
        return F.get(F.array(*[F.lit(float(of[key])) for key in keys]), (F.col("fold") * classes + F.col("k")).cast("int"))

    for _ in range(rounds):
        x = value({key: v[0] for key, v in at.items()}) * F.col("m") + value({key: v[1] for key, v in at.items()})
        target = F.when(F.col("y") == F.col("k"), value(high)).otherwise(value(low))
        rows = flat.select("fold", "k", "m", x.alias("x"), target.alias("t"))
        p = 1.0 / (1.0 + F.exp(-F.col("x")))
        w = p * (1.0 - p)
        loss = F.greatest("x", F.lit(0.0)) + F.log1p(F.exp(-F.abs("x"))) - F.col("t") * F.col("x")
        got = rows.groupBy("fold", "k").agg(
            F.sum(loss).alias("loss"), F.sum((F.col("t") - p) * F.col("m")).alias("g0"), F.sum(F.col("t") - p).alias("g1"),
            F.sum(w * F.col("m") * F.col("m")).alias("h00"), F.sum(w * F.col("m")).alias("h01"), F.sum(w).alias("h11")).collect()
        for r in got:
            key = (r.fold, r.k)
            if key in done:
                continue
            if key in last and r.loss > last[key] + 1e-9 * abs(last[key]):
                step[key] = (step[key][0] / 2, step[key][1] / 2)
                at[key] = (at[key][0] - step[key][0], at[key][1] - step[key][1])
                if max(map(abs, step[key])) < 1e-9:
                    done.add(key)
                continue
            last[key] = r.loss
            if max(abs(r.g0), abs(r.g1)) < 1e-7 * max(1, whole[r.fold]):
                done.add(key)
                continue
            h00, h11 = r.h00 + 1e-9, r.h11 + 1e-9
            det = h00 * h11 - r.h01 * r.h01
            step[key] = ((h11 * r.g0 - r.h01 * r.g1) / det, (h00 * r.g1 - r.h01 * r.g0) / det)
            at[key] = (at[key][0] + step[key][0], at[key][1] + step[key][1])
        if len(done) == len([k for k in keys if whole[k[0]]]):
            break
    return [[at[f, k] for k in range(classes)] for f in range(folds)]


def fit_calibrated(rows: DataFrame, key: str, label: str, vector: str = "embedding", folds: int = 2, iterations: int = 50, reg: float = 0.01) -> CalibratedModel:
    """Balanced multinomial classifiers, each fitted without one fold and calibrated on it.

    Folds are dealt by the hash of ``key``. Rows with a null label or vector are left out. A class that a fold's
    classifier has not seen gets its lowest margin there.
    """
    usable = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    labels = sorted(r[0] for r in usable.select(label).distinct().collect())  # as many as classes
    y = (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("int")
    data = usable.select(y.alias("y"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v"), _fold(F.col(key), folds).alias("fold")).persist()
    try:
        models, held = [], []
        for f in range(folds):
            train = class_weights(data.filter(F.col("fold") != f), "y")
            fit = LogisticRegression(featuresCol="_v", labelCol="y", weightCol="weight", family="multinomial", maxIter=iterations, regParam=reg)
            models.append(fit.fit(train))
            seen = models[-1].numClasses
            scored = _margins(models[-1], data.filter(F.col("fold") == f), "margin")
            if seen < len(labels):
                scored = scored.withColumn("margin", F.concat("margin", F.array_repeat(F.array_min("margin"), len(labels) - seen)))
            held.append(scored.select("fold", "y", "margin"))
        parts = reduce(DataFrame.unionByName, held).persist()
        try:
            return CalibratedModel(labels, models, fit_sigmoids(parts, len(labels), folds))
        finally:
            parts.unpersist()
    finally:
        data.unpersist()
