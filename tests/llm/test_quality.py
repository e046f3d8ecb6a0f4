import zlib

import numpy as np

from geoloom.llm import quality, queries


def test_density_is_the_gaussian(spark):
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x0, x1 = rng.normal(size=(300, d)), rng.normal(size=(500, d)) * 0.5 + 1
    model = quality.fit({k: (float(len(x)), x.sum(axis=0), x.T @ x) for k, x in ((0, x0), (1, x1))})
    own = np.cov(x1.T, bias=True) * len(x1)
    pooled = (np.cov(x0.T, bias=True) * len(x0) + own) / (len(x0) + len(x1) - 2)
    cov = (1 - quality.TO_POOLED) * (own + pooled) / len(x1) + quality.TO_POOLED * pooled
    cov = (1 - quality.TO_DIAGONAL) * cov + quality.TO_DIAGONAL * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(d)
    q = rng.normal(size=(5, d))
    want = [-0.5 * ((r - model.means[1]) @ np.linalg.inv(cov) @ (r - model.means[1]) + np.log(np.linalg.det(cov))) for r in q]
    assert np.allclose(model.log_density(q, 1), want)
    assert (model.score(x1) > 0.5).mean() > 0.95 and (model.score(x0) < 0.5).mean() > 0.95


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.score for r in rows if labels[r.doc_id] == 1], [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean(np.array(good) >= quality.THRESHOLD) > 0.98


def plain_score(text, model):
    """The score of one text, by general linear algebra on the model's means and covariances."""
    x = np.array(quality.statistics(text))
    logs = []
    for k in (0, 1):
        cov = np.linalg.inv(model.whiteners[k].T @ model.whiteners[k])
        logs.append(-0.5 * ((x - model.means[k]) @ np.linalg.solve(cov, x - model.means[k]) + np.linalg.slogdet(cov)[1]))
    odds = (logs[1] - logs[0]) / quality.TEMPERATURE + np.log(model.priors[1] / model.priors[0])
    return 1 / (1 + np.exp(-odds)) if odds > -700 else 0.0


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sums = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in docs and r.quality in (0, 1):
            x = np.array(quality.statistics(docs[r.doc_id]))
            n, a, b = sums.get(r.quality, (0.0, 0.0, 0.0))
            sums[r.quality] = (n + 1, a + x, b + np.outer(x, x))
    model = quality.fit(sums)
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op3_quality(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        want = plain_score(t, model)
        assert np.isclose(got[i][1], want, atol=1e-6) and got[i][0] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i][2] == int(got[i][1] >= 0.3)


def test_long_and_repeated_texts_and_ties():
    long = " ".join(["The cat sat on the mat."] * 200_000)
    assert np.isfinite(quality.statistics(long)).all()
    rows = [np.random.default_rng(k).normal(size=(50, len(quality.FEATURES))) + k for k in (0, 1)]
    model = quality.fit({k: (50.0, x.sum(axis=0), x.T @ x) for k, x in enumerate(rows)})
    # Equal texts tie, and a score at the threshold counts as good.
    assert len({model.score(np.array([quality.statistics("a b"), quality.statistics("a b")]))[k] for k in (0, 1)}) == 1


def test_awkward_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 1), (101, 1), (5, 0), (9, 0), (102, 0), (103, None), (None, 1), (104, 7)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    out = quality.scored(odd_docs, model)
    assert out.columns == odd_docs.columns
    scores = [r.score for r in out.collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    twins = {r.score for r in out.where("doc_id = 7").collect()}
    assert len(twins) == 1
    assert quality.scored(no_docs, model).count() == 0
    unfit = quality.train(odd_docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in quality.scored(odd_docs, unfit).collect())
