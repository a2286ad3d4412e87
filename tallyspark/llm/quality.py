"""Quality rules by robust outliers: minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_broadcast, written
from tallyspark.llm.textstats import with_counts

MIN_WORDS = 20
MAX_REPEATED = 30
#: Share of a stratum whose scatter is made smallest; up to a quarter of it may be bad.
CORE = 0.75
#: A stratum needs so many rows for an estimate of its own; smaller ones are pooled by language.
MIN_ROWS = 200
MAX_STEPS = 12
#: Squared distances above so many times the 0.999 quantile of a normal stratum are rejected.
REJECT = 1.75
SCALE = 1024
#: The transformed statistics and the smallest spread each is given, so that a constant one does not make every
#: deviation infinite.
STATISTICS: dict[str, tuple[str, float]] = {
    "log_words": ("ln(n_words + 1)", 0.10),
    "log_word_length": ("ln((word_chars + 1) / (n_words + 1))", 0.05),
    "symbols": ("sqrt(n_symbols / (n_words + 1))", 0.10),
    "upper": ("sqrt(n_upper / (word_chars + 1))", 0.05),
    "digits": ("sqrt(n_digits / (word_chars + 1))", 0.08),
    "variety": ("ln((n_distinct + 1) / (n_words + 1))", 0.05),
    "repeated_lines": ("sqrt(n_dup_lines / (n_lines + 1))", 0.15),
    "repeated_words": ("sqrt(n_repeat_words / (n_words + 1))", 0.15),
}
P = len(STATISTICS)
_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MODEL = "key string, start int, mean array<double>, weight array<double>, size long, det double, rows long, settled boolean"


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def scatter(n: int, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (times ``factor``, plus the smallest spreads) from integer sums."""
    mean = sums / n
    cov = np.empty((P, P))
    for (i, j), s in zip(_PAIRS, products):
        cov[i, j] = cov[j, i] = s / n - mean[i] * mean[j]
    floors = np.array([f * SCALE for _, f in STATISTICS.values()])
    return mean, cov * factor + np.diag(floors ** 2)


def model_row(key: str, start: int, size: int, rows: int, mean: np.ndarray, cov: np.ndarray, settled: bool) -> tuple:
    weight = np.linalg.inv(cov)
    flat = [float(weight[i, j] * (1 if i == j else 2)) for i, j in _PAIRS]
    return key, start, mean.tolist(), flat, size, float(np.linalg.slogdet(cov)[1]), rows, settled


def _distance() -> Column:
    d = [f"({x} - mean[{i}])" for i, x in enumerate(_X)]
    return F.expr(" + ".join(f"weight[{k}] * {d[i]} * {d[j]}" for k, (i, j) in enumerate(_PAIRS)))


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)],
            *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"p{k}") for k, (i, j) in enumerate(_PAIRS)]]


_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"p{k}" for k in range(len(_PAIRS))]]


def _apart(total) -> tuple[int, np.ndarray, np.ndarray]:
    total = np.array(total, dtype=float)
    return int(total[0]), total[1:P + 1], total[P + 1:]


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts per stratum: medians and quartile ranges, and the moments of all rows.

    Quartiles come from counts per value, at a resolution of ``1 / 64``; both starts are sums of integers, so they do
    not depend on the order of the rows.
    """
    cells = rows.select("key", F.posexplode(F.array(*_X)).alias("at", "x")).groupBy("key", "at", F.floor(F.col("x") / 16).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("key", "at", F.col("cell").cast("double").alias("value"), F.array("n").alias("sums"))
    whole = rows.groupBy("key").agg(*_sums()).select("key", F.lit(-1).alias("at"), F.lit(0.0).alias("value"), F.array(*_SUMS).alias("sums"))

    def start(frame):
        import pandas as pd

        key = frame["key"].iloc[0]
        size, sums, products = _apart(frame.loc[frame["at"] == -1, "sums"].iloc[0])
        mid, spread = np.zeros(P), np.zeros(P)
        for i in range(P):
            part = frame[frame["at"] == i].sort_values("value")
            n = np.array([s[0] for s in part["sums"]]).cumsum()
            q = part["value"].to_numpy()[np.searchsorted(n, n[-1] * np.array([0.25, 0.5, 0.75]))] * 16 + 8
            mid[i], spread[i] = q[1], (q[2] - q[0]) / 1.349
        floors = np.array([f * SCALE for _, f in STATISTICS.values()])
        robust = model_row(key, 0, size, size, mid, np.diag(spread ** 2 + floors ** 2), False)
        plain = model_row(key, 1, size, size, *scatter(size, sums, products, 1.0), False)
        return pd.DataFrame([robust, plain], columns=[f.split()[0] for f in _MODEL.split(", ")])

    return cells.unionByName(whole).groupBy("key").applyInPandas(start, _MODEL)


def _c_step(rows: DataFrame, model: DataFrame, core: float) -> DataFrame:
    """One concentration step for all strata and starts: the rows of smallest distance give the next estimate.

    Rows are summed up per band of distance in the map tasks (eight bands per doubling); a stratum takes whole bands
    until they hold its core. So a stratum of any size reaches the last step as a few hundred rows.
    """
    near = rows.join(bounded_broadcast(model.select("key", "start", "mean", "weight")), "key")
    band = F.floor(F.log2(_distance() + F.lit(0.001)) * 8).cast("int")
    bands = near.withColumn("band", band).groupBy("key", "start", "band").agg(*_sums())
    bands = bands.select("key", "start", "band", F.array(*_SUMS).alias("sums"), F.lit(None).cast("double").alias("det"))
    before = model.select("key", "start", F.lit(None).cast("int").alias("band"), F.lit(None).cast("array<long>").alias("sums"), "det")
    quantile = chi2_quantile(core, P)
    factor = core / chi2_cdf(quantile, P + 2)

    def step(frame):
        import pandas as pd

        out = []
        for start, part in frame.groupby("start"):
            last = part.loc[part["band"].isna(), "det"].iloc[0]
            part = part[part["band"].notna()].sort_values("band")
            sums = np.array(part["sums"].tolist(), dtype=object)
            held = np.cumsum(sums[:, 0].astype(np.int64))
            taken = int(np.searchsorted(held, math.ceil(core * held[-1]))) + 1
            n, s, p = _apart(sums[:taken].sum(axis=0))
            row = model_row(frame["key"].iloc[0], int(start), n, int(held[-1]), *scatter(n, s, p, factor), False)
            out.append((*row[:-1], abs(row[5] - last) < 1e-9))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _MODEL.split(", ")])

    return bands.unionByName(before).groupBy("key").applyInPandas(step, _MODEL)


def _reweighted(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The start of smallest determinant, then moments of the rows within its 0.975 ellipsoid."""
    def best(frame):
        return frame.sort_values(["det", "start"]).head(1)

    chosen = written(model.groupBy("key").applyInPandas(best, _MODEL), "mcd-best")
    limit = chi2_quantile(0.975, P)
    near = rows.join(bounded_broadcast(chosen.select("key", "mean", "weight")), "key").filter(_distance() <= limit)
    sums = near.groupBy("key").agg(*_sums()).select("key", F.array(*_SUMS).alias("sums"))
    factor = 0.975 / chi2_cdf(limit, P + 2)

    def fit(frame):
        import pandas as pd

        n, s, p = _apart(frame["sums"].iloc[0])
        return pd.DataFrame([model_row(frame["key"].iloc[0], 0, n, n, *scatter(n, s, p, factor), True)],
                            columns=[f.split()[0] for f in _MODEL.split(", ")])

    return written(sums.groupBy("key").applyInPandas(fit, _MODEL), "mcd")


def mcd(rows: DataFrame, core: float = CORE, steps: int = MAX_STEPS) -> DataFrame:
    """Estimates per ``key`` from the integer vectors ``x0..`` of all rows: concentration steps until every stratum is
    settled or ``steps`` are done, then one reweighting step."""
    model = written(_starts(rows), "mcd-start")
    for _ in range(steps):
        model = written(_c_step(rows, model, core), "mcd-step")
        if not model.filter(~F.col("settled")).limit(1).count():
            break
    return _reweighted(rows, model)


#: Names of the pools beyond one language; strata are named by JSON objects.
_REST, _CORPUS = "small languages", "corpus"


def _pools(rows: DataFrame, min_rows: int) -> DataFrame:
    """``own``, ``key``: the stratum that each language and source is judged in, from the smallest that is large enough.

    Counts have one row per language and source. Without ``min_rows`` rows in all there is no key.
    """
    counts = rows.groupBy("own", "pool").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    of_pool = counts.filter(small).groupBy("pool").agg(F.sum("n").alias("in_pool"))
    counts = counts.join(of_pool, "pool", "left")
    rest = counts.filter(small & (F.col("in_pool") < min_rows)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_rest"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_all"))
    counts = counts.join(F.broadcast(rest)).join(F.broadcast(total))  # one row each
    key = (F.when(~small, F.col("own")).when(F.col("in_pool") >= min_rows, F.concat(F.lit("pool "), "pool"))
           .when(F.col("in_rest") >= min_rows, F.lit(_REST)).when(F.col("in_all") >= min_rows, F.lit(_CORPUS)))
    return counts.select("own", key.alias("key"))


def judged(docs: DataFrame, min_rows: int = MIN_ROWS, core: float = CORE, reject: float = REJECT) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` (squared, null without estimate) and ``kept`` of every row.

    Base rules: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` per cent of the words in repeated
    windows. Rows that pass them are held against the estimate of their language and source, or, where that stratum
    has fewer than ``min_rows`` rows, of all such small strata of the language; languages that stay below it are one
    pool, and if that is small as well its rows are held against the whole corpus. So every such row has a distance as
    soon as ``min_rows`` rows pass the base rules. Estimates come from all rows that pass the base rules; a stratum that
    has not settled after the last step keeps the estimate of that step.

    Null text: no words, fails the base rules. Null language or source: a stratum of its own. Repeated rows and ids
    are judged row by row; rows at equal distance get the same verdict. A text of any length is read whole in the task
    that holds it. Other columns are ignored. An empty table gives an empty result.
    """
    stats = with_counts(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    vector = [F.round(F.expr(e) * SCALE).cast("long").alias(x) for x, (e, _) in zip(_X, STATISTICS.values())]
    stats = stats.select("*", failed.alias("base_failed"), *vector,
                         F.to_json(F.struct("lang", "source")).alias("own"), F.to_json(F.struct("lang")).alias("pool"))
    stats = written(stats, "statistics")
    keys = written(_pools(stats.filter(~F.col("base_failed")), min_rows), "strata")
    stats = stats.join(bounded_broadcast(keys), "own", "left")
    passed = stats.filter(~F.col("base_failed"))
    fitted = passed.select("key", *_X).filter(F.col("key") != _CORPUS)
    if keys.filter(F.col("key") == _CORPUS).head() is not None:
        fitted = fitted.union(passed.select(F.lit(_CORPUS), *_X))
    model = mcd(fitted, core).select("key", "mean", "weight")
    limit = reject * chi2_quantile(0.999, P)
    seen = stats.join(bounded_broadcast(written(model, "mcd-used")), "key", "left")
    distance = F.when(F.col("mean").isNotNull(), _distance())
    return seen.withColumn("distance", F.round(distance, 6)).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).drop("own", "pool", "key", "mean", "weight", *_X)


def report(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
