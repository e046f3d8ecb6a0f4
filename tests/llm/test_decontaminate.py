import random
import re

from geoloom.llm import decontaminate
from tests.llm.conftest import awkward, prose


def words(text):
    return [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]


def plain(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def items():
    rng = random.Random(5)
    long = awkward()[5][1].split()
    rows = [(1, " ".join(long[100:130])), (2, " ".join(long[29_960:30_000])), (3, prose(rng, 30)), (4, None), (5, ""), (6, "one"), (7, "one two"), (8, awkward()[6][1]), (8, prose(rng, 12)), (None, awkward()[6][1])]
    part = long[200:230]
    part[-5] = "changed"  # a word near the end spoils five of the shingles
    rows += [(11, " ".join(long[500:503])), (12, " ".join(long[700:704]).upper()), (13, long[900]), (14, "zzz " + long[900])]
    return [*rows, (9, " ".join(part)), (10, " ".join(part[:20] + ["x", "y"] + part[22:]))]


def test_against_brute_force(spark, odd_docs):
    bench = spark.createDataFrame([(*r, "z") for r in items()], "item_id long, text string, partition string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.contained(odd_docs, bench).collect()}
    want = {}
    for d, text, _ in awkward():
        for i, item in items():
            k = min(5, len(words(item)))
            s = plain(item, k) if k else set()
            n = len(s & plain(text, k)) if k else 0
            if s and n >= 0.8 * len(s) and (n / len(s), n) > (want.get((d, i), (0, 1))[1] / want.get((d, i), (0, 1))[0] if (d, i) in want else -1, 0):
                want[d, i] = (len(s), n)
    assert got == want
    assert (6, 1) in got and (6, 2) in got and (None, 8) in got and (6, 11) in got and (6, 12) in got and (6, 13) in got and (6, 14) not in got


def test_empty_tables(spark, no_docs, odd_docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.contained(no_docs, bench).count() == 0
    assert decontaminate.contained(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_clean_documents_keep_columns(spark, odd_docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    clean = decontaminate.clean_documents(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    ids = [r.doc_id for r in clean.collect()]
    # The row without an id holds item 8 as row 7 does: it is judged by its text.
    assert 6 not in ids and 7 not in ids and 3 in ids and None not in ids
    both = spark.createDataFrame([(None, "nothing of the kind here at all", 1, 2), (None, awkward()[6][1], 3, 4), (5, awkward()[6][1], 5, 6), (5, "clean", 7, 8)], "doc_id long, text string, _row int, hash int")
    assert sorted((r._row, r.hash) for r in decontaminate.clean_documents(both, bench).collect()) == [(1, 2), (7, 8)]


def test_short_items_are_found_inside_longer_documents(spark):
    docs = spark.createDataFrame([(1, "See how the Quick, brown fox jumps over it"), (2, "quick brown cat, fox jumps")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, "brown fox jumps over"), (3, "cat")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, bench).collect()} == {(1, 1), (1, 2), (2, 3)}


def test_sql_gives_the_same(spark, sf):
    import duckdb

    from geoloom.llm import queries

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.execute(f"select doc_id, item_id, n_shingles, n_shared from ({queries.OP2_SQL}) order by 1, 2").fetchall()
    assert want and want == sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in queries.op2_benchmark_decontamination(spark, sf).collect())
