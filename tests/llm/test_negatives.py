import math

import numpy as np
import pyarrow as pa

from geoloom.llm import negatives

COLUMNS = "vec_id long, embedding array<double>, label int, score string, rank int, q int"


def brute(rows, every=50, positives=5, count=3):
    """All rows of the contract by plain loops and Python's integers; rows are numbered, as ids may repeat."""
    part = []
    for k, (i, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for k, i, label, v in part:
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0, n, j, m) for n, j, m, w in part if n != k and len(w) == len(v)]
        scored.sort(key=lambda t: t[:4])
        for s, *_, j, _ in [t for t in scored if t[5] == label][:positives]:
            fits = [t for t in scored if t[5] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:count]
            out += [(i, j, r + 1, t[4], -s, -t[0]) for r, t in enumerate(fits)]
    return sorted(out, key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in negatives.mined(df, **kw).collect()), key=str)


def test_strassen_is_exact():
    rng = np.random.default_rng(0)
    for m, k, n in ((1, 1, 1), (33, 65, 40), (64, 64, 128), (100, 0, 5), (97, 31, 203)):
        a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        for leaf in (1, 2, 16):
            assert (negatives.strassen(a, b, leaf) == a.astype(object) @ b.astype(object)).all()
    # What overflows on the way is right in the end, as int64 is a ring.
    a, b = rng.integers(-(2**31), 2**31, (40, 3)), rng.integers(-(2**29), 2**29, (3, 40))
    assert (negatives.strassen(a, b, 1) == a.astype(object) @ b.astype(object)).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    scores = rng.integers(-3, 3, (7, 50))
    scores[2, 3:] = negatives.NONE
    scores[4] = negatives.NONE
    heap = negatives.Heap(7, 4)
    for a in (slice(0, 3), slice(3, 7)):
        for r in range(0, 50, 13):
            heap.put(a, scores[a, r : r + 13].copy(), r)
    for line, rows in zip(scores, heap.row, strict=True):
        want = [j for j in sorted(range(50), key=lambda j: (-int(line[j]), j)) if line[j] != negatives.NONE][:4]
        assert [j for j in rows if j >= 0] == want


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(10, 8))
    rows = []
    for k in range(400):
        # Half the rows have one label; coarse vectors make ties.
        label = 3 if k % 2 else int(rng.integers(0, 10))
        v = np.round(base[label] * 0.5 + rng.normal(size=8) * 0.6, 1)
        rows.append((k, v.tolist(), label, "x", 1, 2))
    rows += [rows[50]] * 3 + [rows[61]] * 4 + [(900 + k, *rows[61][1:]) for k in range(3)]
    rows += [(1000, None, 1, "", 0, 0), (1050, [1.0] * 8, None, "", 0, 0), (1100, [float("nan")] + [1.0] * 7, 1, "", 0, 0), (1150, [None] + [1.0] * 7, 1, "", 0, 0), (1200, [float("-inf")] + [1.0] * 7, 1, "", 0, 0)]
    rows += [(1250, [], 1, "", 0, 0), (1251, [], 1, "", 0, 0), (1252, [], 2, "", 0, 0), (1300, [0.0] * 8, 5, "", 0, 0), (1350, [0.5, 0.25], 4, "", 0, 0), (1351, [0.5, 0.5], 4, "", 0, 0), (1352, [0.25, 0.5], 6, "", 0, 0), (1400, [0.5, 0.5], 4, "", 0, 0), (None, rows[61][1], 2, "", 0, 0), (-100, rows[10][1], 3, "", 0, 0)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    want = brute(rows)
    assert len(want) > 50 and found(df) == want
    assert negatives.mined(df.limit(0)).count() == 0
    assert negatives.mined(df.where("vec_id = 50").limit(1)).count() == 0


def test_many_shards_and_groups(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 40)
    monkeypatch.setattr(negatives, "GROUP", 3)
    monkeypatch.setattr(negatives, "TILE", (2, 16))
    rng = np.random.default_rng(3)
    rows = [(5 * k, np.round(rng.normal(size=5) + 0.6, 1).tolist(), int(rng.integers(0, 3)), "", 0, 0) for k in range(200)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert found(df) == brute(rows)


def test_vectors_too_long_for_exact_scores_take_no_part(spark):
    rows = [(0, [1e30, 1.0], 1, "", 0, 0), (7, [1.0, 1.0], 0, "", 0, 0), (50, [1.0, 1.0], 1, "", 0, 0), (51, [0.7, 0.7], 2, "", 0, 0)]
    assert found(spark.createDataFrame(rows, COLUMNS)) == brute(rows[1:])


def test_window_of_extreme_scores():
    assert negatives._window(2**62, (50, 95)) == (2**61, 95 * 2**62 // 100)
    assert negatives._window(-100, (50, 95)) == (-50, -95)
    assert pa.table({"q": pa.array([[]] * 2, pa.list_(pa.int64()))}).num_rows == len(negatives._matrix(pa.table({"q": pa.array([[]] * 2, pa.list_(pa.int64()))})))
