"""Toxicity categories by a classifier chain of linear models, trained on out-of-fold probabilities."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written
from tallyspark.llm.textstats import chunks, codes

CATEGORIES = ("toxic", "severe")
#: Labelled rows that the chain is fitted on, at most; the ones with the smallest digest of their id.
TRAIN_ROWS = 6_000
FOLDS = 4
BITS = 20
#: Features enter a model if their counts in the two classes differ by so many standard deviations.
MIN_SCORE = 4.0
MIN_ROWS = 4
STEPS = 200
RIDGE = 0.02
#: The threshold is the lowest, down to a quarter, at which so small a share of the clean training rows is called toxic
#: by models that did not see them.
FALSE_SHARE = 0.001
THRESHOLDS = (0.5, 0.45, 0.4, 0.35, 0.3, 0.25)
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, its heads and tails, as numbers below ``2 ** BITS``."""
    parts = {f"w{word}"} | {f"h{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n} | {f"t{word[-n:]}" for n in (4, 5) if len(word) >= n}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in sorted(parts)]


def distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(text, word) index pairs of the distinct words of each text, and the features of each word."""
    found, counts, unique = codes([t.encode("utf-8", "surrogatepass") for t in texts])
    plain = [w.decode("utf-8", "surrogatepass").lower().strip(_STRIP) for w in unique]
    index: dict[str, int] = {}
    to = np.fromiter((index.setdefault(w, len(index)) for w in plain), dtype=np.int64, count=len(plain))
    doc = np.repeat(np.arange(len(texts)), counts)
    pairs = np.unique(doc * max(1, len(index)) + to[found]) if len(found) else doc
    doc, word = pairs // max(1, len(index)), pairs % max(1, len(index))
    known = [word_features(w) if w else [] for w in index]
    return doc, word, known


class Linear:
    """A logistic model over the number of distinct words that have a feature, with a few dense inputs."""

    def __init__(self, dense: int):
        self.dense, self.features, self.weights, self.extra, self.bias = dense, np.zeros(0, int), np.zeros(0), np.zeros(dense), 0.0

    def fit(self, rows: np.ndarray, features: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        """``rows`` and ``features``: one entry per distinct word and feature. Steps of a fixed length in the mean loss."""
        n, positive = len(y), float(y.sum())
        self.bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
        if positive in (0.0, float(n)):
            return self
        cells, times = np.unique(rows * (1 << BITS) + features, return_counts=True)
        row, feature = cells >> BITS, cells & ((1 << BITS) - 1)
        have = np.bincount(feature, minlength=1 << BITS)
        hits = np.bincount(feature, weights=y[row], minlength=1 << BITS)
        share = positive / n
        score = (hits - have * share) / np.sqrt(have * share * (1 - share) + 1)
        self.features = np.flatnonzero((have >= MIN_ROWS) & (np.abs(score) >= MIN_SCORE))
        place = np.full(1 << BITS, -1)
        place[self.features] = np.arange(len(self.features))
        kept = place[feature] >= 0
        row, column, value = row[kept], place[feature[kept]], np.minimum(times[kept], 3).astype(float)
        k = len(self.features)
        theta, mean, square = np.zeros(k + self.dense + 1), 0.0, 0.0
        theta[-1] = self.bias
        decay = np.r_[np.full(k, RIDGE / 10), np.full(self.dense, RIDGE / 10), 0.0]
        for t in range(1, STEPS + 1):
            z = np.bincount(row, weights=value * theta[column], minlength=n) + dense @ theta[k:k + self.dense] + theta[-1]
            gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.r_[np.bincount(column, weights=value * gap[row], minlength=k), dense.T @ gap, gap.sum()] / n + decay * theta
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            theta -= 0.05 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
        self.weights, self.extra, self.bias = theta[:k], theta[k:k + self.dense], float(theta[-1])
        return self

    def predict(self, n: int, rows: np.ndarray, features: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.full(n, self.bias) + dense @ self.extra
        if len(self.features) and len(rows):
            place = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
            kept = self.features[place] == features
            cells, times = np.unique(rows[kept] * len(self.features) + place[kept], return_counts=True)
            z += np.bincount(cells // len(self.features), weights=self.weights[cells % len(self.features)] * np.minimum(times, 3), minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _flat(doc: np.ndarray, word: np.ndarray, known: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """One entry per (text, distinct word, feature)."""
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    every = np.fromiter((f for fs in known for f in fs), dtype=np.int64, count=int(starts[-1]))
    n = sizes[word] if len(word) else np.zeros(0, np.int64)
    at = np.repeat(starts[word] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum())) if len(word) else np.zeros(0, np.int64)
    return np.repeat(doc, n), every[at]


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))) / 4


def fit_chain(texts: list[str], labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> tuple[list[Linear], np.ndarray]:
    """The models of all categories in order, and the out-of-fold probabilities of the training rows.

    Model k sees the text and the probabilities of the categories before it. In training these come from models that
    did not see the row, so a later model learns how far an earlier one can be trusted.
    """
    rows, features = [], []
    at = 0
    for part in chunks(texts):
        r, f = _flat(*distinct_words(part))
        rows.append(r + at)
        features.append(f)
        at += len(part)
    rows, features = np.concatenate(rows), np.concatenate(features)
    n = len(texts)
    dense = np.zeros((n, 0))
    models, held_out = [], np.zeros((n, labels.shape[1]))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        for f in range(folds):
            out = fold == f
            inside = ~out[rows]
            place = np.cumsum(~out) - 1
            model = Linear(dense.shape[1]).fit(place[rows[inside]], features[inside], dense[~out], y[~out])
            other = np.cumsum(out) - 1
            held_out[out, k] = model.predict(int(out.sum()), other[rows[~inside]], features[~inside], dense[out])
        models.append(Linear(dense.shape[1]).fit(rows, features, dense, y))
        dense = np.column_stack([dense, _logit(held_out[:, k])])
    return models, held_out


def predict_chain(models: list[Linear], texts: list[str]) -> np.ndarray:
    rows, features = _flat(*distinct_words(texts))
    dense, out = np.zeros((len(texts), 0)), []
    for model in models:
        out.append(model.predict(len(texts), rows, features, dense))
        dense = np.column_stack([dense, _logit(out[-1])])
    return np.column_stack(out)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of at most ``limit`` labelled documents, the same ones on every run.

    Ids are cut by digest first, so the text join gets a bounded side.
    """
    ids = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = written(ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit), "train-ids")
    return docs.filter("doc_id is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, folds: int = FOLDS) -> bytes | None:
    """The fitted chain, made in one task from a bounded sample; null if there is no labelled row.

    The labels say toxic or not. The second category, ``severe``, is cut from the first: toxic documents whose share of
    marked words (ten times likelier in toxic training rows) is at least the median of the toxic rows.
    """
    def fit(frame):
        import pandas as pd

        frame = frame.drop_duplicates("doc_id").sort_values("doc_id")
        texts = [t or "" for t in frame["text"]]
        toxic = frame["toxic"].to_numpy(dtype=int)
        labels = np.column_stack([toxic, severity(texts, toxic)])
        fold = np.array([zlib.crc32(str(i).encode()) % folds for i in frame["doc_id"]])
        models, held_out = fit_chain(texts, labels, fold, folds)
        return pd.DataFrame({"model": [pickle.dumps((models, threshold_of(held_out[:, 0], toxic)))]})

    got = training_rows(docs, labels, limit).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "model binary").collect()
    return bytes(got[0].model) if got else None


def threshold_of(p: np.ndarray, toxic: np.ndarray) -> float:
    clean = p[toxic == 0]
    fine = [t for t in THRESHOLDS if not len(clean) or (clean >= t).mean() <= FALSE_SHARE]
    return min(fine, default=THRESHOLDS[0])


def severity(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    counts = {0: {}, 1: {}}
    words = [{w.strip(_STRIP) for w in t.lower().split()} for t in texts]
    for seen, y in zip(words, toxic):
        for w in seen:
            counts[y][w] = counts[y].get(w, 0) + 1
    n1, n0 = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    marked = {w for w, n in counts[1].items() if n >= MIN_ROWS and n / n1 >= 10 * (counts[0].get(w, 0) + 0.5) / n0}
    share = np.array([len(seen & marked) / max(1, len(seen)) for seen in words])
    if not toxic.any():
        return np.zeros(len(texts), int)
    return ((toxic == 1) & (share > 0) & (share >= np.median(share[toxic == 1]))).astype(int)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, a probability per category (``p_toxic``, ``p_severe``), ``toxic`` and ``kept`` of every row of ``docs``.

    ``labels``: ``doc_id``, ``toxic`` (0/1). A bounded sample of the labelled documents (``limit``) fits the chain; every
    whole text is scored where it lies, without a shuffle.

    Null text counts as empty. Labels without document, null labels and null ids in ``labels`` are ignored; of repeated
    label rows the toxic one counts, of repeated training documents the first. Without any labelled document
    probabilities are null and every row is kept. A probability at the threshold counts as toxic. A text of any length is
    scored whole. Other columns are ignored. An empty table gives an empty result.
    """
    blob = train(docs, labels, limit)
    models, threshold = pickle.loads(blob) if blob else ([], 1.0)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            parts = [predict_chain(models, part) for part in chunks(batch.column(1).to_pylist())]
            table = np.concatenate(parts or [np.zeros((0, len(names)))]).round(6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in table.T]], ["doc_id", *names])

    rows = docs.select("doc_id", "text")
    if blob is None:
        scored = rows.select("doc_id", *[F.lit(None).cast("double").alias(n) for n in names])
    else:
        scored = rows.mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *[f"{n} double" for n in names]]))
    toxic = F.coalesce(F.col("p_toxic") >= threshold, F.lit(False))
    return scored.select("*", toxic.alias("toxic"), (~toxic).alias("kept"))
