import zlib
from collections import Counter, defaultdict

from geoloom.llm import sharding
from tests.llm.conftest import awkward, prose


def invariants(rows, docs):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard <= 7 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return Counter({s: sum(r.size for r in rows if r.shard == s) for s in slots})


def test_awkward_rows(odd_docs, no_docs):
    invariants(sharding.shard(odd_docs).collect(), [(i, t) for i, t, _ in awkward()])
    assert sharding.shard(no_docs).count() == 0


def test_even_although_a_third_are_copies(spark):
    import random

    rng = random.Random(2)
    copy = prose(rng, 50)
    docs = [(k, copy if k % 3 == 0 else prose(rng, rng.randint(1, 100))) for k in range(6000)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sizes = invariants(rows, docs)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * mean and min(sizes.values()) >= 0.95 * mean


def test_small_groups_stay_together(spark):
    docs = [(k, f"text {k // 5} of a group of five copies") for k in range(8000)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r.doc_id // 5].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    sizes = invariants(rows, docs)
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 8
