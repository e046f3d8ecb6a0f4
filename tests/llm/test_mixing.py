import re
from collections import defaultdict

import duckdb

from geoloom.llm import mixing, queries
from tests.llm.conftest import awkward


def check(rows, sizes):
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), n) for i, n, _ in sizes)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_targets_against_resharing(spark, odd_docs):
    sizes = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in awkward()]
    rows = mixing.mix(odd_docs).collect()
    check(rows, sizes)
    total = defaultdict(int)
    for _, n, s in sizes:
        total[s] += n
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: k % 3 + 1.0 for k, s in enumerate(names)}
    target, full = {}, {}
    left, open_ = float(sum(total.values())), dict(weight)
    while True:
        target = {s: full.get(s, left * open_.get(s, 0) / sum(open_.values())) for s in names}
        over = [s for s in open_ if target[s] > 3 * total[s] + 1e-9]
        if not over:
            break
        for s in over:
            full[s] = 3.0 * total[s]
            left -= full[s]
            del open_[s]
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == total[r.source]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s])
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(odd_docs.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in rows)


def test_seats_are_dealt_to_the_highest_quotients(spark):
    t = spark.createDataFrame([("a", 1000, 1.0, 5300.0), ("b", 900, 2.0, 2400.0), (None, 5000, 3.0, 1300.0), ("z", 0, 1.0, 0.0)], "source string, source_size long, weight double, target double")
    q = mixing.quotas(t, 4).collect()
    block = q[0].block_words
    n = int(9000 / block + 0.5)
    seats, won = {"a": 0, "b": 0, None: 0}, []
    goal = {"a": 5300.0, "b": 2400.0, None: 1300.0}
    for _ in range(n):
        best = max(seats, key=lambda s: (goal[s] / (2 * seats[s] + 1), s is not None))
        seats[best] += 1
        won.append(best)
    got = {(r.source, r.shard): r.blocks for r in q}
    for h in range(4):
        run = won[n * h // 4 : n * (h + 1) // 4]
        for s in seats:
            assert got[s, h] == run.count(s)


def test_shards_take_their_quotas_of_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    by_shard, sizes = defaultdict(int), {}
    for r in rows:
        assert r.taken == sum(e.words for e in r.shards) and len({e.shard for e in r.shards}) == len(r.shards)
        sizes[r.source] = (r.source_size, r.target)
        for e in r.shards:
            by_shard[r.source, e.shard] += e.words
    weights = {s: k % 3 + 1.0 for k, s in enumerate(sorted(s for s in sizes if s is not None))}
    t = spark.createDataFrame([(s, n, weights.get(s, 1.0), g) for s, (n, g) in sizes.items()], "source string, source_size long, weight double, target double")
    want = {(r.source, r.shard): r.blocks * r.block_words for r in mixing.quotas(t).collect()}
    for s, (n, _) in sizes.items():
        for h in range(mixing.SHARDS):
            # Only the end of a source that is taken three times whole may cut a block.
            assert by_shard[s, h] == want[s, h] or sum(want[s, k] for k in range(h + 1)) > 3 * n


def test_whole_documents(spark, odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    assert max(v for k, v in counts.items() if k != 7) <= 3 and counts[7] <= 6
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    blank = odd_docs.where("doc_id < 4")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0, 0]


def test_copies_are_those_of_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += 1
    assert got == want


def test_clashing_names_and_rows_without_ids(spark):
    rows = [(None, f"text number {k} of many", "s", k, k, k, k, k) for k in range(300)] + [(1, "one id, two texts", "s", 1, 1, 1, 1, 1), (1, "one id, two other texts", "s", 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, size int, row int, key int, last1 int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    # The only source has its words taken once, but for what doesn't fill a block.
    got = [r.text for r in out.collect()]
    assert len(set(got)) == len(got) >= 300 and set(got) <= {r[1] for r in rows}
    assert len({r[0] for r in docs.select(mixing._key("doc_id", "text", 42)).distinct().collect()}) == 301


def test_sql_gives_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select doc_id, size, source_size, taken from ({queries.OP9_SQL}) order by 1").fetchall()
    got = sorted((r.doc_id, r.size, r.source_size, r.taken) for r in queries.op9_mixing(spark, sf).collect())
    assert got == [tuple(r) for r in want]
