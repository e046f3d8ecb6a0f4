import numpy as np

from geoloom.llm import embeddings


def brute(ids, vecs):
    ok = np.array([v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vecs])
    n, comp = np.zeros(len(ids), int), list(ids)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if o else None for v, o in zip(vecs, ok, strict=True)]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if ok[a] and ok[b] and len(vecs[a]) == len(vecs[b]) and unit[a] @ unit[b] >= 0.9]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for _ in ids:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return n, comp


def test_lattice_point_is_nearest():
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    p = embeddings.nearest_point(x)
    d = ((x - p) ** 2).sum(axis=1)
    for r in embeddings.ROOTS:
        assert (d <= ((x - p - r) ** 2).sum(axis=1) + 1e-9).all()
    assert ((2 * p) % 1 == 0).all() and len(embeddings.ROOTS) == 240


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 16))
    vecs = [b.tolist() for b in base]
    for k in range(60):
        step = rng.normal(size=16)
        vecs.append((base[k % 40] + 0.25 * step).tolist())
    vecs += [vecs[3]] * 5 + [(np.array(vecs[4]) * 7).tolist(), (np.array(vecs[5]) * 1e200).tolist()]
    vecs += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.1]]
    ids = list(range(len(vecs)))
    rng.shuffle(ids)
    rows = [(int(i), v, 0) for i, v in zip(ids, vecs, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    n, comp = brute([r[0] for r in rows], vecs)
    assert len(got) == len(rows)
    found = sum(got[i][0] for i, *_ in rows)
    assert all(got[i][0] <= k for (i, *_), k in zip(rows, n, strict=True)) and found >= 0.9 * n.sum()
    assert np.mean([got[i][1] == c for (i, *_), c in zip(rows, comp, strict=True)]) > 0.95
    assert all(g[2] == (i == g[1]) for i, g in got.items())
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    t = df.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.array(t.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = embeddings.near_duplicates(df).toPandas().sort_values("vec_id").n_links.to_numpy()
    assert (got <= n).all() and got.sum() >= 0.9 * n.sum()


def test_hot_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(2)
    center = rng.normal(size=32)
    rows = [(k, (center + 0.05 * rng.normal(size=32)).tolist()) for k in range(150)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}
