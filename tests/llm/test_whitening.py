import math

import numpy as np
import pytest

from geoloom.llm import whitening


def symmetric(rng, values):
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


def test_inertia_counts_signs():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 7, 30):
        for _ in range(20):
            a = rng.normal(size=(d, d))
            a = a + a.T
            assert whitening.inertia(a)[0] == (np.linalg.eigvalsh(a) > 0).sum()
    # Zero diagonals need pivots of two rows.
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0)
    assert whitening.inertia(np.array([[0.0, 1, 2], [1, 0, 3], [2, 3, 0]]))[0] == 1
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1e6, 1, 1e-3, 1e-6], [2, 2, 2, 1, 1], [3], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [4, 1, 0, 0]])
def test_leading_eigenvalues(values):
    v = symmetric(np.random.default_rng(1), values)
    got, vectors = whitening.leading(v, 16)
    kept = [x for x in values if x]
    assert np.allclose(got, kept, rtol=1e-9, atol=1e-14 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(kept)), atol=1e-9)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * values[0]


def test_only_so_many(monkeypatch):
    v = symmetric(np.random.default_rng(2), np.linspace(1, 9, 40).tolist())
    calls = []
    own = whitening.inertia
    monkeypatch.setattr(whitening, "inertia", lambda a: calls.append(1) or own(a))
    got, _ = whitening.leading(v, 16)
    assert np.allclose(got, np.linalg.eigvalsh(v)[::-1][:16]) and len(calls) < 16 * 20
    assert len(whitening.leading(np.zeros((4, 4)))[0]) == 0


def brute(rows, most=16):
    """The contract's values by Python's integers and numpy's eigenvectors."""
    ok = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit, strict=True)]
    left = np.array([[n * x - s for x, s in zip(v, sums, strict=True)] for v in fit], object)
    cov = ((left.T @ left) / n**3).astype(float)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for i, x in ok:
        y = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), y @ vectors / np.sqrt(values), values / np.trace(cov))
    return out, d


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(20, 20))
    rows = [(k, (rng.normal(size=20) @ mixing / 20).tolist(), 1, 2) for k in range(300)]
    rows += [(1000 + k, rows[k % 3][1], 1, 2) for k in range(50)]  # copies don't count in the fit
    rows += [(2000, None, 0, 0), (2001, [None] + [0.0] * 19, 0, 0), (2002, [float("nan")] * 20, 0, 0), (2003, [float("inf")] * 20, 0, 0), (2004, [], 0, 0), (2005, [1e300] * 20, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component int").repartition(4)
    got = whitening.whitened(df).collect()
    want, _ = brute([r for r in rows if r[0] != 2005])
    assert len(got) == 16 * 350 and {r.vec_id for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained[k] - 1) < 1e-9
        signs.setdefault(k, set()).add(np.sign(r.whitened * w[k]))
        assert abs(abs(r.whitened) - abs(w[k])) < 1e-8
        assert r.identity_error < 1e-9
    assert all(len(s - {0.0}) == 1 for s in signs.values())  # either sign, but the same for all rows


def test_empty_constant_and_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    rows = [(1, [0.5]), (2, [1.5]), (3, [1.0, 2.0]), (4, [3.0, 2.0]), (None, [2.0, 5.0]), (4, [3.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted([("1", 1, 2), ("2", 1, 2)] + [(i, c, 3) for i in ("3", "4", "4", "None") for c in (1, 2)])


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, 3.0]), (2, [-1e12, 1.0]), (3, [5e11, 2.0]), (4, [2e15, 0.0])]
    got = {r.vec_id: r for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.component == 1}
    want, _ = brute(rows)
    for i, r in got.items():
        assert r.deviation == (want[i][1] if want[i][1] < 2**63 else None)
        assert abs(abs(r.whitened) - abs(want[i][2][0])) < 1e-8
