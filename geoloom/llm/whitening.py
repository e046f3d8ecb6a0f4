"""Whitening of embeddings by spectrum slicing.

Vectors are made whole numbers, so that sums, squares and the covariance are exact. The covariance's leading
eigenvalues are found one by one: the signs of the pivots of an LDL' factorisation of ``V - s I`` count the eigenvalues
above s, halving by such counts isolates an eigenvalue, and Rayleigh quotient iteration, which converges cubically,
finishes it. Counts on either side of the result certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import drop_written, written

#: An entry c counts as ``floor(SCALE * c) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
_ROOT = (1 + np.sqrt(17)) / 8
_LONG = 2**63


def inertia(a: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are positive, and how many are zero.

    By Sylvester's law they have the signs of D's in ``P A P' = L D L'``; D has pivots of one row or two, chosen by size
    (Bunch and Kaufman), so that no pivot is small against what it divides.
    """
    a, k, n = np.array(a, float), 0, len(a)
    above = zero = 0
    while k < n:
        size, own = 1, abs(a[k, k])
        column = np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        if max(own, most) == 0:
            zero, k = zero + 1, k + 1
            continue
        if own < _ROOT * most:
            r = k + 1 + int(column.argmax())
            line = np.abs(a[r, k:])
            line[r - k] = 0
            if own * line.max() < _ROOT * most**2:
                other, size = (r, 1) if abs(a[r, r]) >= _ROOT * line.max() else (r, 2)
                to = k + size - 1
                a[[to, other]] = a[[other, to]]
                a[:, [to, other]] = a[:, [other, to]]
        if size == 1:
            above += a[k, k] > 0
            w = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(w / a[k, k], w)
        else:
            above += 1  # a pivot of two rows, chosen so, has one eigenvalue of either sign
            w = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= w @ np.linalg.solve(a[k : k + 2, k : k + 2], w.T)
        k += size
    return int(above), zero


def _above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues of ``v`` are greater than s."""
    return inertia(v - s * np.eye(len(v)))[0]


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a covariance matrix, falling, and their unit eigenvectors as columns.

    At most ``most``, and only those that differ from zero beyond rounding. Eigenvalues that no count can part share an
    interval; their vectors are made orthogonal to each other, and any such basis is right.
    """
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    grain = size * d * np.finfo(float).eps
    values: list[float] = []
    vectors = np.empty((d, 0))
    # Counts that are known: of eigenvalues above a point, from the least to the greatest point.
    known = {size + grain: 0, grain: _above(v, grain)} if size else {}
    for number in range(1, min(most, known.get(grain, 0)) + 1):
        low, high = max(s for s, c in known.items() if c >= number), min(s for s, c in known.items() if c < number)
        value = vector = None
        while value is None:
            if high - low <= 4 * grain or known[low] - known[high] == 1:
                value, vector = _polished(v, low, high, vectors, grain)
            if value is None:
                middle = (low + high) / 2
                known[middle] = _above(v, middle)
                low, high = (middle, high) if known[middle] >= number else (low, middle)
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    out = np.array(values)
    order = np.argsort(-out, kind="stable")  # inside an interval that no count parts
    out, vectors = out[order], vectors[:, order]
    for number, value in enumerate(out, 1):
        if not _above(v, value + 8 * grain) < number <= _above(v, value - 8 * grain):
            raise ArithmeticError(f"eigenvalue {number} isn't where the counts have it")
    return out, vectors


def _polished(v: np.ndarray, low: float, high: float, found: np.ndarray, grain: float) -> tuple[float, np.ndarray] | tuple[None, None]:
    """The eigenvalue in ``(low, high]`` and its vector by Rayleigh quotient iteration; None if it leaves the interval."""
    d, slack = len(v), 4 * grain if high - low <= 4 * grain else 0.0
    rng = np.random.default_rng(d)
    apart = lambda x: x - found @ (found.T @ x)
    x = apart(rng.normal(size=d))
    x /= np.linalg.norm(x)
    s = (low + high) / 2
    for step in range(50):
        try:
            y = np.linalg.solve(v - s * np.eye(d), x)
        except np.linalg.LinAlgError:  # s is an eigenvalue to the last bit
            y = np.linalg.solve(v - (s + grain / d) * np.eye(d), x)
        y = apart(apart(y))
        x = y / np.linalg.norm(y)
        # Two steps by the middle, then by the quotient.
        s = float(x @ v @ x) if step else s
        if step and not low - slack < s <= high + slack:
            return None, None
        if step > 1 and np.linalg.norm(v @ x - s * x) <= grain / 4:
            break
    else:
        if not slack:
            return None, None
    return s, x


@dataclass(frozen=True)
class Whitening:
    """What is known of the vectors of one length: the fit list's size, sums and components."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        """The whole number nearest to the mean, by dimension."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """``x - mean`` on the components, over the roots of the eigenvalues."""
        middle = self.middle
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, middle, strict=True)])
        return ((x - middle).astype(float) - rest) @ self.vectors / np.sqrt(self.values)


def whole(c: Column) -> Column:
    """The vector as whole numbers, less ``OFFSET``: null if it or an entry is null or not finite, or too large for a long."""
    fits = F.forall(c, lambda x: F.coalesce((F.abs(x.cast("double")) * SCALE < float(2**62)) & ~F.isnan(x), F.lit(False)))
    return F.when(fits, F.transform(c, lambda x: F.floor(x.cast("double") * SCALE)))


def _rows(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the length, which rows have it, and their vectors as a matrix of whole numbers with the offset."""
    c = b.column(column)
    lengths = np.diff(c.offsets.to_numpy())
    flat = c.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, flat[starts[at][:, None] + np.arange(d)] + OFFSET


def _exact(y: np.ndarray, most: int) -> np.ndarray:
    """As it is, or as Python's integers where a sum of its products might leave 64 bits."""
    return y.astype(object) if int(np.abs(y).max(initial=0)) ** 2 * most >= _LONG // 2 else y


def _totals(fit: DataFrame, each, entries: str) -> dict[int, dict]:
    """Sum what ``each(d, matrix)`` gives for the fit list, by length and place: partial sums per task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _rows(b, "x"):
                held[d] = held[d] + each(d, x) if d in held else each(d, x)
        for d, v in held.items():
            flat = v.ravel()
            kind = pa.float64() if entries == "double" else pa.decimal128(38, 0)
            value = pa.array(flat.tolist() if entries == "double" else [_decimal(i) for i in flat.tolist()], kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), value], ["d", "i", "v"])

    sums = fit.select("x").mapInArrow(run, f"d int, i int, v {entries}").groupBy("d", "i").agg(F.sum("v").alias("v"))
    out: dict[int, dict] = {}
    for r in sums.collect():  # as many rows as the covariances have entries, whatever the rows
        out.setdefault(r["d"], {})[r["i"]] = r["v"]
    return out


def _decimal(i: int):
    from decimal import Decimal

    return Decimal(i)


def fit(vectors: DataFrame, vec_col: str = "embedding", most: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vectors: over each distinct whole-number vector once.

    Only sums come to the driver, as many as the covariance has entries. Vectors without entries have none.
    """
    distinct = vectors.select(whole(F.col(vec_col)).alias("x")).where(F.size("x") > 0).distinct()
    rows = written(distinct, "fit")
    firsts = _totals(rows, lambda d, x: np.concatenate([[len(x)], _exact(x, len(x)).sum(axis=0)]), "decimal(38,0)")
    sums = {d: (int(t[0]), tuple(int(t[i]) for i in range(1, d + 1))) for d, t in firsts.items()}
    centres = {d: Whitening(n, s, 0.0, np.empty(0), np.empty((d, 0))).middle for d, (n, s) in sums.items()}

    def products(d: int, x: np.ndarray) -> np.ndarray:
        y = _exact(x - centres[d], len(x))  # centred before it is multiplied
        return (y.T @ y).astype(object)

    squares = _totals(rows, products, "decimal(38,0)")
    out = {}
    for d, (n, s) in sums.items():
        left = [a - n * int(m) for a, m in zip(s, centres[d], strict=True)]  # what centring by whole numbers leaves
        v = np.array([[(n * int(squares[d][i * d + j]) - left[i] * left[j]) / n**2 for j in range(d)] for i in range(d)])
        values, vecs = leading(v, most)
        out[d] = Whitening(n, s, float(np.trace(v)), values, vecs)

    def again(d: int, x: np.ndarray) -> np.ndarray:
        w = out[d].whitened(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    errors = _totals(rows, again, "double")
    drop_written(rows)
    for d, w in out.items():
        k = len(w.values)
        t = np.array([errors[d][i] for i in range(k + k * k)]) if k else np.zeros(0)
        mean = t[:k] / w.n
        cov = t[k:].reshape(k, k) / w.n - np.outer(mean, mean)
        out[d] = Whitening(w.n, w.sums, w.trace, w.values, w.vectors, float(np.abs(cov - np.eye(k)).max(initial=0.0)))
    return out


def _deviations(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Sums over the dimensions of ``(n x - S)**2``, exact; null where they leave 64 bits."""
    y = x - w.middle
    left = np.array([s - w.n * int(m) for s, m in zip(w.sums, w.middle, strict=True)], object)
    if (w.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * x.shape[1] < _LONG:
        return ((w.n * y - left.astype(np.int64)) ** 2).sum(axis=1)
    exact = ((w.n * y.astype(object) - left) ** 2).sum(axis=1)
    return np.array([e if e < _LONG else None for e in exact], object)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each row and component up to ``most``.

    Rows whose vector is null, or holds entries that are null, not finite or beyond a long, are dropped; rows with a null id
    keep it, repeated rows stay repeated. Vectors of different lengths have nothing in common: each length is fitted by
    itself. Components whose eigenvalue is zero, beyond rounding, can't be whitened and are left out, so that constant
    vectors, a single one and empty ones give no rows; an empty table gives an empty one. ``deviation`` is null where it
    leaves 64 bits. Other columns are not read.
    """
    model = fit(vectors, vec_col, most)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in _rows(b, "x"):
                w = model[d]
                k = len(w.values)
                if not k:
                    continue
                n = len(at)
                same = lambda v, n=n: pa.array(np.tile(v, n))
                deviation = pa.array(_deviations(x, w).tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(at, k))), same(np.arange(1, k + 1, dtype=np.int32)), same(np.full(k, w.n)), deviation.take(pa.array(np.repeat(np.arange(n), k))),
                     pa.array(w.whitened(x).ravel()), same(w.values / w.trace), same(np.full(k, w.identity_error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col(id_col), whole(F.col(vec_col)).alias("x")).where(F.size("x") > 0).mapInArrow(run, schema)
