"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and its diagonal. A score is the logistic of
the difference of the two log-densities, each from the Mahalanobis distance by the class's Cholesky factor, which is
computed and inverted once and sent with the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.cluster import written

FEATURES = (
    "log_words", "log_word_length", "upper", "symbols", "marked_words", "shouted_words", "bars", "exclaims", "digits", "stops", "repeats", "top_word", "repeated_words", "short_words", "log_line", "odd_lines"
)
#: Shares of the pooled covariance, and then of its diagonal, in each class's covariance.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
THRESHOLD = 0.3
#: The log-odds are divided by this: statistics of one text aren't independent, and quadratic scores are overconfident.
TEMPERATURE = 4.0

_SYMBOLS = b"#$%&*|~^<>{}[]\\=+@_"
_LETTERS_UP = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = frozenset(b"#$%&*|~^<>{}=+@_")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text: logarithms of lengths, square roots of shares."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    letters = sum(map(len, words))
    count = lambda chars: letters - len(raw.translate(None, chars + b" \t\n\r\x0b\x0c"))
    tally = Counter(words)
    lines = raw.split(b"\n")
    # Shares of a few words are drawn towards 0, where those of ordinary texts are.
    many, chars = n + 10, letters + 60
    shares = (
        count(_LETTERS_UP) / chars,
        count(_SYMBOLS) / chars,
        sum(c for w, c in tally.items() if w[-1] in _MARKS) / many,
        sum(c for w, c in tally.items() if w.isupper() and len(w) > 1) / many,
        raw.count(b"|") / many,
        raw.count(b"!") / many,
        count(_DIGITS) / chars,
        (raw.count(b".") + raw.count(b",")) / many,
        sum(map(bytes.__eq__, words[1:], words)) / many,
        (max(tally.values()) - 1) / many,
        (n - len(tally)) / many,
        sum(c for w, c in tally.items() if len(w) <= 3) / many,
    )
    odd = sum(not line or line[:1].islower() or line[:1] in b"|#*-" for line in lines) / (len(lines) + 2)
    root = [s**0.5 for s in shares]
    return [np.log1p(n), np.log(letters / n), *root, np.log1p(n / len(lines)), odd**0.5]


@dataclass(frozen=True)
class Discriminant:
    """For each class: prior, mean, the inverse of the covariance's Cholesky factor, and the log-determinant."""

    means: np.ndarray
    whiteners: np.ndarray
    logdets: np.ndarray
    priors: np.ndarray

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.whiteners[k] @ (x - self.means[k]).T
        return -0.5 * ((z * z).sum(axis=0) + self.logdets[k])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of statistics."""
        odds = (self.log_density(x, 1) - self.log_density(x, 0)) / TEMPERATURE + np.log(self.priors[1] / self.priors[0])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """The model from each class's count, sum and sum of outer products. A class without rows is like the pooled one.

    The prior is the share of a class among the labelled rows, each counted once more.
    """
    d = len(FEATURES)
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    total = sum(n.values())
    prior = (n[1] + 1) / (total + 2)
    if not total:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.array([1 - prior, prior]))
    middle = sum(s[1] for s in sums.values()) / total
    means = np.stack([sums[k][1] / n[k] if n[k] else middle for k in (0, 1)])
    inner = {k: sums[k][2] - n[k] * np.outer(means[k], means[k]) if n[k] else np.zeros((d, d)) for k in (0, 1)}
    pooled = (inner[0] + inner[1]) / max(total - 2, 1)
    whiteners, logdets = [], []
    for k in (0, 1):
        own = (inner[k] + pooled) / max(n[k], 1)
        cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiteners.append(np.tril(np.linalg.inv(factor)))
        logdets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.stack(whiteners), np.array(logdets), np.array([1 - prior, prior]))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x``: the statistics of each whole text, in place of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, x array<double>")


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """The sufficient statistics of each class from ``x, y``: sums in each task, then one for each class and position."""
    d = len(FEATURES)
    width = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, width))
        for b in batches:
            x, y = b.column(0).flatten().to_numpy().reshape(-1, d), b.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                out[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width)), pa.array(np.tile(np.arange(width), 2)), pa.array(out.ravel())], ["y", "i", "v"])

    sums = rows.select("x", "y").mapInArrow(run, "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, width))
    for r in sums:
        flat[r["y"], r["i"]] = r["v"]
    return {k: (flat[k, 0], flat[k, 1 : 1 + d], flat[k, 1 + d :].reshape(d, d)) for k in (0, 1) if flat[k, 0]}


def _fitted(measures: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Discriminant:
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)").distinct()
    return fit(class_sums(measures.join(own, "id")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """Fit on every labelled row; labels other than 0 and 1 and null ids teach nothing.

    Texts become statistics where they are read; only those meet the labels. An id with both labels teaches both.
    """
    return _fitted(measured(docs, id_col, text_col), labels, id_col, label_col)


def train_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col, score`` for each row of ``docs``, by the model that ``train`` fits: each text is read and measured once."""
    measures = written(measured(docs, id_col, text_col), "measures")
    held = docs.sparkSession.sparkContext.broadcast(_fitted(measures, labels, id_col, label_col))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(held.value.score(np.array(xs.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    return measures.select(F.col("id").alias(id_col), F.pandas_udf(score, "double")("x").alias("score"))


def _probability(model: Discriminant, spark: SparkSession, text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            yield pd.Series(held.value.score(x))

    return F.pandas_udf(score, "double")(text)


def scored(docs: DataFrame, model: Discriminant, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1. Null and blank texts have all statistics 0 and a score too.

    Repeated rows score alike; an empty table stays empty; a column named like ``to`` is replaced.
    """
    return docs.withColumn(to, _probability(model, docs.sparkSession, F.col(text_col)))


def kept(docs: DataFrame, model: Discriminant, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose texts score at least ``least``, with all their columns and no others."""
    return docs.where(_probability(model, docs.sparkSession, F.col(text_col)) >= least)
