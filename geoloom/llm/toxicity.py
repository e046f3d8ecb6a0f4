"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised log-likelihood.

A toxic and an ordinary model share vocabulary and back-off. Each interpolates pairs of words with words, words with
their beginnings of six, four and three letters, and those with what both classes hold together. Counts are
Kneser-Ney's: after how many different words a word or a pair occurs, so that a text with many copies counts once.

Labelled texts are few and mostly ordinary prose, so that the plain ratio of the models is mostly noise of rare words.
At each level it therefore counts only beyond ``ERRORS`` standard errors of the shared counts and a margin ``TOPIC``,
and falls back to the level below otherwise; the README gives the accuracy without either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.cluster import written


#: The models are fitted on so many labelled documents of each class at most, those whose ids have the least hash.
MOST_DOCUMENTS = 3000
#: So many bytes of text of each class at most, in the same order.
MOST_BYTES = 64 << 20
#: The ordinary model may see so many documents for each toxic one.
ORDINARY = 3
DISCOUNT = 0.75
BEGINNINGS = (6, 4, 3)
#: Of each level's log-ratio so many standard errors, and so much besides, are put down to chance and topic.
ERRORS, TOPIC = 2.0, 0.7
#: The curve where the labelled documents are too few to fit one.
FLAT = (20.0, -1.0)
THRESHOLD = 0.5
#: Words that a worker remembers with their places.
REMEMBERED = 400_000
_MARKS = b".,!?;:\"'()[]{}*#$%&|<>-_/"


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z lower-cased; marks around them go when they are looked up."""
    return (text or "").encode().lower().split()


@dataclass
class Ratio:
    """Log-ratios toxic to ordinary. ``places`` numbers the vocabulary; level 0 is words, the others beginnings."""

    places: dict[bytes, int]
    word: np.ndarray
    beginnings: list[dict[bytes, float]]
    pairs: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    known: dict[bytes, int] = field(default_factory=dict, repr=False)
    extra: list[float] = field(default_factory=list, repr=False)

    def _unseen(self, w: bytes) -> float:
        for n, table in zip(BEGINNINGS, self.beginnings, strict=True):
            if (r := table.get(w[:n])) is not None:
                return r
        return 0.0

    def _place(self, raw: bytes) -> int:
        """The word's number, or for a word that isn't in the vocabulary one above all numbers."""
        at = self.known.get(raw)
        if at is None:
            w = raw.strip(_MARKS)
            at = self.places.get(w)
            if at is None:
                at = len(self.word) + len(self.extra)
                self.extra.append(self._unseen(w) if w else 0.0)
            self.known[raw] = at
        return at

    def mean(self, text: str | None) -> float:
        """The root of the mean log-ratio of a text's words, each after the one before; 0 for a text without words.

        Roots keep thinly toxic texts apart from ordinary ones, whose means are much closer to 0.
        """
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.extra.clear()
        ws = words(text)
        if not ws:
            return 0.0
        n = len(self.word)
        at = np.fromiter(map(self._place, ws), np.int64, len(ws))
        alone = np.where(at < n, self.word[np.minimum(at, n - 1)] if n else 0.0, 0.0)
        new = np.flatnonzero(at >= n)
        if len(new):
            alone[new] = [self.extra[k] for k in (at[new] - n).tolist()]
        both = np.flatnonzero((at[1:] < n) & (at[:-1] < n)) + 1
        if len(both) and len(self.pairs):
            key = at[both - 1] * n + at[both]
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[k] == key
            alone[both[hit]] = self.pair[k[hit]]
        m = float(alone.mean())
        return float(np.copysign(np.sqrt(abs(m)), m))

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.slope * np.array([self.mean(t) for t in texts]) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "extra": []}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, each class weighing the same, with a slight pull to 0."""
    scale = x.std() or 1.0
    z, a = x / scale, np.zeros(2)
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        grad = design.T @ (w * (p - y)) + 1e-3 * a * (1, 0)
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        a = a - np.linalg.solve(hess, grad)
    return a[0] / scale, a[1]


def fit(toxic: list[str], ordinary: list[str]) -> Ratio:
    """Fit both models on whole texts, and the curve from the mean ratio to a probability by two-fold estimates."""
    model = _models(toxic, ordinary)
    if not toxic or not ordinary:
        model.slope = model.offset = 0.0
        return model
    x, y = [], []
    for fold in (0, 1):
        other = _models(toxic[1 - fold :: 2], ordinary[1 - fold :: 2])
        for k, texts in ((1, toxic), (0, ordinary)):
            x += [other.mean(t) for t in texts[fold::2]]
            y += [k] * len(texts[fold::2])
    model.slope, model.offset = _logistic(np.array(x), np.array(y, float))
    if model.slope <= 0:  # too few documents to tell
        model.slope, model.offset = FLAT
    return model


def _models(toxic: list[str], ordinary: list[str]) -> Ratio:
    places: dict[bytes, int] = {}
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for texts in (ordinary, toxic):
        at, start = [], []
        for t in texts:
            ws = [s for w in words(t) if (s := w.strip(_MARKS))]
            at += [places.setdefault(w, len(places)) for w in ws]
            start += [True, *[False] * (len(ws) - 1)] if ws else []
        rows.append((np.array(at, np.int64), np.array(start, bool)))
    n = len(places)
    if not n:
        return Ratio(places, np.zeros(0), [{} for _ in BEGINNINGS], np.zeros(0, np.int64), np.zeros(0))
    pair_keys, wider = [], []
    for at, start in rows:
        inner = np.flatnonzero(~start[1:]) + 1 if len(at) else np.zeros(0, np.int64)
        pair_keys.append(at[inner - 1] * n + at[inner])
        wider.append(np.where(start[inner - 1], n, at[inner - 2]))
    keys, inverse = np.unique(np.concatenate(pair_keys), return_inverse=True)
    # Pairs count, like words, once for each different word before them: copies of a text add nothing.
    pairs = np.zeros((2, len(keys)))
    for k, own in enumerate(np.split(inverse, [len(pair_keys[0])])):
        pairs[k] = np.bincount(np.unique(own * (n + 1) + wider[k]) // (n + 1), minlength=len(keys))

    # From the shortest beginnings up: each level interpolates its own discounted counts with the level below, and its
    # ratio differs from that below by what chance doesn't explain.
    vocabulary = list(places)
    contexts = np.stack([np.bincount((keys % n)[pairs[k] > 0], minlength=n) for k in (0, 1)]).astype(float)
    spread = contexts.sum(axis=0) + 1.0
    sums = np.maximum(contexts.sum(axis=1), 1)
    tables, below, base = [], np.ones((2, n)), np.zeros(n)
    for length in (*reversed(BEGINNINGS), None):
        names: dict[bytes, int] = {}
        of = np.array([names.setdefault(w[:length], len(names)) for w in vocabulary])
        c = np.stack([np.bincount(of, contexts[k], minlength=len(names)) for k in (0, 1)])
        spare = np.maximum(DISCOUNT * (c > 0).sum(axis=1), 1e-9) / sums
        first = np.zeros(len(names), np.int64)
        first[of] = np.arange(n)
        share = np.bincount(of, spread) / (spread.sum() if not tables else np.bincount(parent, spread)[parent[first]])
        p = np.maximum(c - DISCOUNT, 0) / sums[:, None] + spare[:, None] * below[:, first] * share
        down = base[first]
        r = down + _beyond_chance(np.log(p[1]) - np.log(p[0]) - down, c)
        below, base, parent = p[:, of], r[of], of
        tables.insert(0, dict(zip(names, r.tolist(), strict=True)))
    left, right = keys // n, keys % n
    seen = np.stack([np.bincount(left, pairs[k], minlength=n) for k in (0, 1)])
    types = np.stack([np.bincount(left, pairs[k] > 0, minlength=n) for k in (0, 1)])
    # A context that a class lacks gives all its weight to the words.
    weight = np.where(seen > 0, np.maximum(DISCOUNT * types, 1e-9) / np.maximum(seen, 1), 1.0)
    joint = np.where(seen[:, left] > 0, np.maximum(pairs - DISCOUNT, 0) / np.maximum(seen[:, left], 1), 0) + weight[:, left] * below[:, right]
    r = base[right] + _beyond_chance(np.log(joint[1]) - np.log(joint[0]) - base[right], pairs)
    # Other pairs have the ratio of their second word, which they back off to.
    keep = np.abs(r - base[right]) > 1e-9
    return Ratio(places, base, tables[1:], keys[keep], r[keep])


def _beyond_chance(r: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-ratios drawn to 0 by what they would vary if both classes shared the counts by their sizes.

    Before that, they are held to the ratio of the counts themselves, a half added to each.
    """
    sizes = counts.sum(axis=1) + 1
    plain = np.diff(np.log((counts + 0.5) / sizes[:, None]), axis=0)[0]
    r = np.where(r * plain > 0, np.sign(r) * np.minimum(np.abs(r), np.abs(plain)), 0.0)
    even = counts.sum(axis=0) * (sizes / sizes.sum())[:, None] + 0.5
    chance = ERRORS * np.sqrt((1 / even).sum(axis=0)) + TOPIC
    return np.sign(r) * np.maximum(np.abs(r) - chance, 0)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_DOCUMENTS, most_bytes: int = MOST_BYTES
) -> Ratio:
    """Fit on at most ``most`` labelled documents of each class, chosen by the hash of their ids, and ``most_bytes`` of text.

    There are at most three ordinary documents for a toxic one, or the other way round. The bounds hold the model, and
    what the driver sees, to a fixed size, also if texts are very long. Labels other than 0 and 1 and null ids teach
    nothing; ties of the hash are broken by the id; a repeated row is read as often as it stands, within the bounds.
    """
    own = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y IN (0, 1)").distinct()
    own = own.withColumn("_key", F.xxhash64("_id"))
    chosen = [own.where(F.col("_y") == y).orderBy("_key", "_id").limit(most) for y in (0, 1)]
    fewest = min(c.count() for c in chosen)
    chosen = [c.orderBy("_key", "_id").limit(fewest * ORDINARY) for c in chosen]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen[0].unionByName(chosen[1]), "_id")
    # Few rows, by the bound; their sizes are summed before a text leaves the executors.
    rows = written(rows, "labelled")
    by_size = Window.partitionBy("_y").orderBy("_key", "_id", F.xxhash64("_text")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("_id", "_y", "_key", "_text", F.sum(F.least(F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long"), F.lit(most_bytes + 1))).over(by_size).alias("_upto"), F.row_number().over(by_size).alias("_k"))
    got = sizes.where((F.col("_upto") <= most_bytes) & (F.col("_k") <= most)).orderBy("_y", "_k").select("_text", "_y").toPandas()
    return fit(*[[t for t, k in zip(got["_text"], got["_y"], strict=True) if k == y and t] for y in (1, 0)])


def scored(docs: DataFrame, model: Ratio, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic.

    Null and blank texts have a mean ratio of 0 and the score that belongs to it. Repeated rows score alike; an empty
    table stays empty; a column named like ``to`` is replaced. Without labels of both classes all scores are 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(list(texts)), dtype=float)

    return docs.withColumn(to, F.pandas_udf(score, "double")(F.col(text_col)))
