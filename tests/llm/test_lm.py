import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import gru, lm, queries
from geoloom.llm.text import bucket
from tests.llm.conftest import awkward


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def base_scores(rows):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))) for _, t in rows]


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(scale=0.3, size=v.shape).astype(np.float32) for k, v in gru.initial(np.ones(gru.SHORT + gru.TAIL)).items()}
    texts = [rng.integers(0, gru.SHORT + gru.TAIL, 12).astype(np.int32) for _ in range(3)]
    texts[0][3:6] = texts[1][2:5] = gru.SHORT + 2
    y = np.stack(texts, axis=1)
    x = np.concatenate([np.zeros((1, 3), np.int32), y[:-1]])
    first = np.zeros(x.shape, bool)
    first[0] = True
    g, count, _ = gru.Trainer(p).gradients(x, y, first, np.ones((gru.HIDDEN, 3), np.float32))
    assert count == y.size
    for name in p:
        for at in np.argsort(-np.abs(g[name]).ravel())[[0, 1, 5, 20, 60]].tolist():
            moved = []
            for by in (0.01, -0.01):
                q = {k: v.copy() for k, v in p.items()}
                q[name].ravel()[at] += by
                moved.append(gru.log_likelihoods(q, texts).sum())
            assert math.isclose((moved[0] - moved[1]) / 0.02, g[name].ravel()[at], rel_tol=0.03, abs_tol=0.01), (name, at)


def test_training_helps():
    rng = np.random.default_rng(0)
    p = gru.initial(np.ones(gru.SHORT + gru.TAIL))
    texts = [rng.integers(0, gru.SHORT + gru.TAIL, n).astype(np.int32) for n in (7, 4, 9)]
    trainer = gru.Trainer(p)
    before = gru.log_likelihoods(p, texts).sum()
    for _ in range(30):
        trainer.train(texts)
    assert gru.log_likelihoods(trainer.p, texts).sum() > before + 5


def test_probabilities_sum_to_one():
    p = gru.initial(np.random.default_rng(1).random(gru.SHORT + gru.TAIL) * 9)
    h = np.random.default_rng(2).normal(size=(gru.HIDDEN + 1, 1)).astype(np.float32)
    h[-1] = 1
    every = np.arange(gru.SHORT + gru.TAIL)
    lp = gru.output(p, np.repeat(h, len(every), axis=1), every)[0]
    assert abs(np.exp(lp.astype(float)).sum() - 1) < 1e-4


def test_state_is_carried_and_texts_are_apart():
    p = gru.initial(np.ones(gru.SHORT + gru.TAIL))
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 1000, n).astype(np.int32) for n in (300, 5, 1, 40, 41)]
    together = gru.log_likelihoods(p, texts)
    alone = [gru.log_likelihoods(p, [t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-3)


def test_against_brute_force(spark, odd_docs, no_docs):
    for common in (lm.COMMON, 5):
        got = lm.scored(odd_docs, bucket(F.col("doc_id"), 5) == 1, common=common).collect()
        n, want = base_scores([(i, t) for i, t, _ in awkward()])
        key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
        have = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=key)
        assert have == sorted(((i, a, b, round(c, 6)) for (i, _, _), (a, b, c) in zip(awkward(), want, strict=True)), key=key)
        assert all(r.train_tokens == n and r.score < 0 and r.held_out == held(r.doc_id) for r in got)
    assert lm.scored(no_docs, bucket(F.col("doc_id"), 5) == 1).count() == 0
    untrained = lm.scored(odd_docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_partitions_of_the_rows_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "SPLIT", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    some, other = ({r.doc_id: (r.base_score, r.score) for r in lm.scored(docs.repartition(n, "text"), bucket(F.col("doc_id"), 5) == 1).collect()} for n in (1, 6))
    assert some.keys() == other.keys()
    assert all(np.allclose(some[i], other[i], rtol=1e-5, atol=1e-4) for i in some)


def test_better_than_counts_on_held_out_texts(spark):
    rows = [r for r in queries.op10_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.8
