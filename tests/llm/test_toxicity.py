import random

import numpy as np

from geoloom.llm import queries, toxicity
from tests.llm.conftest import prose


def test_ratio_finds_rare_kin():
    rng = random.Random(4)
    bad = lambda: f"vile{rng.choice(['n', 'st', 'nesses', 'x', 'ry'])}"
    toxic = [f"{prose(rng, 20)} {bad()} {prose(rng, 10)} {bad()}" for _ in range(80)]
    plain = [prose(rng, rng.randint(5, 60)) for _ in range(160)]
    model = toxicity.fit(toxic, plain)
    new, other = [f"{prose(rng, 25)} vilextra vilexly {prose(rng, 5)}" for _ in range(30)], [prose(rng, 31) for _ in range(30)]
    assert (model.score(new) > 0.5).mean() > 0.9 and (model.score(other) < 0.5).mean() > 0.9


def test_texts_of_toxic_words_only():
    """Evidence that fills a text isn't set off against itself, and repeating it doesn't take it away."""
    rng = random.Random(4)
    toxic = [f"{prose(rng, 20)} vile {prose(rng, 10)} foul" for _ in range(80)]
    plain = [prose(rng, rng.randint(5, 60)) for _ in range(160)]
    model = toxicity.fit(toxic, plain)
    short = ["vile", "foul", "vile foul", "vile vile foul", "foul vile vile vile", "vile foul vile foul vile"]
    assert (model.score(short) > 0.9).all() and model.score([""])[0] < 0.5
    one, many = model.mean(f"{plain[0]} vile"), model.mean(f"{plain[0]} {'vile ' * 200}")
    assert many > one


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op8_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    bad, good = [r.score for r in rows if labels[r.doc_id] == 1], [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([b > g for g in good for b in bad]) > 0.93
    assert np.mean(np.array(bad) >= 0.5) > 0.85 and np.mean(np.array(good) >= 0.5) < 0.05


def test_training_is_bounded_in_bytes(spark, monkeypatch):
    """Very long texts don't go to the driver: what is beyond the bound isn't read."""
    rng = random.Random(4)
    rows = [(k, prose(rng, 30) + (" vile" if k % 2 else "")) for k in range(60)] + [(100 + k, "vile " * 200_000) for k in range(3)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(100 + k, 1) for k in range(3)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda a, b: seen.append((sum(map(len, a)), sum(map(len, b)))))
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, most_bytes=5000)
    assert all(0 < n <= 5000 for n in seen[0])


def test_a_long_text_scores():
    rng = random.Random(4)
    model = toxicity.fit([f"{prose(rng, 20)} vile {prose(rng, 10)} foul" for _ in range(80)], [prose(rng, rng.randint(5, 60)) for _ in range(160)])
    assert model.score([prose(rng, 100_000)])[0] < 0.5


def test_awkward_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 1), (101, 1), (5, 0), (2, 0), (102, 0), (103, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    out = toxicity.scored(odd_docs, model)
    assert out.columns == odd_docs.columns and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.scored(no_docs, model).count() == 0
    blind = toxicity.train(odd_docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.scored(odd_docs, blind).collect()} == {0.5}
