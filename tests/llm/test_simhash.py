import itertools
import random
import re

import xxhash

from geoloom.llm import simhash
from tests.llm.conftest import awkward


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Smallest id reachable from each (id, fingerprint) by links of at most two bits."""
    comp = {k: i for k, (i, _) in enumerate(fps)}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(fps)), 2):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2 and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


def test_fingerprint_is_the_plain_one():
    for _, text, _ in awkward()[:25]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_awkward_rows(odd_docs):
    got = sorted((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(odd_docs).collect() if r.id is not None)
    rows = [(i, plain_fingerprint(t)) for i, t, _ in awkward() if i is not None]
    comp = components(rows)
    assert got == sorted((i, f, comp[k]) for k, (i, f) in enumerate(rows))


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_first(no_docs).count() == 0


def test_links_of_close_fingerprints(spark):
    """Random chains of one and two flips, and a slot that is too full for pairs, against all pairs."""
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    low = rng.getrandbits(32)
    hub = rng.getrandbits(32)
    fps |= {(hub ^ (1 << a) ^ (1 << b)) << 32 | low for a in range(32) for b in range(a)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in got)
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        parent[find(r.a)] = find(r.b)
    for a, b in itertools.combinations(signed, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
            assert find(a) == find(b)


def test_similar_texts_link(spark):
    """Copies with a few words changed, of short and long texts, against the similarity of their shingle sets."""
    rng = random.Random(8)
    docs, id_ = [], 0
    for n in (40, 150, 600):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(6):
            words = list(base)
            for _ in range(k * n // 150):
                words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            docs.append((id_, " ".join(words)))
            id_ += 1
    docs += [(900 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(80))) for k in range(30)] + [(1000, None), (1001, ""), (None, docs[0][1])]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in docs if t and i is not None}
    got = {(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(docs, "doc_id long, text string"), 0.8).collect()}
    for a, b in got - {(1000, 1001)}:
        assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7
    joined = {a: a for a in sets}
    for _ in sets:
        for a, b in got:
            if a in joined and b in joined:
                joined[a] = joined[b] = min(joined[a], joined[b])
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.88:
            assert joined[a] == joined[b]


def test_band_keys_and_sets_are_those_of_the_text():
    for _, text, _ in awkward()[:25]:
        fp, keys, five = simhash.bands(text)
        assert fp == plain_fingerprint(text) and len(keys) == simhash.BANDS
        words = (text or "").lower().split()
        assert len(five) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else ())
    one, other = (simhash.shingle_set(t) for t in ("a b c d e f g", "x b c d e f g"))
    assert len(set(one.tolist()) & set(other.tolist())) == 2


def test_rows_without_or_with_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(9)
    some = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(None, some[0], 1), (1, some[1], 2), (None, some[2], 3), (None, some[2], 4), (2, some[1], 5), (3, some[3], 6), (3, some[0], 7), (3, some[3], 8), (None, None, 9), (4, "", 10)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, _hash int"))
    assert kept.columns == ["doc_id", "text", "_hash"]
    got = sorted(r._hash for r in kept.collect())
    # 1 has a copy with an id, 7; of 3 and 4, and of 6 and 8, which agree in all, one stays; 10 is blank as 9 is.
    assert len(got) == 5 and {2, 7, 10} <= set(got) and len({3, 4} & set(got)) == 1 and len({6, 8} & set(got)) == 1


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for k in range(600):
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        docs.append((k, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert simhash.similar_links(d, 0.8).count() < 9 * len(docs)
    assert [r.doc_id for r in simhash.keep_first(d).collect()] == [0]


def test_keep_first_keeps_columns(odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 6, 7} and 8 not in {r.doc_id for r in kept.collect()}


def whole_sets(docs):
    words = {i: t.split() for i, t in docs}
    return {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}


def alike(a, b):
    return len(a & b) / len(a | b)


def sharing(docs):
    """Pairs of ids whose texts share a band."""
    filed = {}
    for i, t in sorted(docs):
        for k in simhash.bands(t)[1].tolist():
            filed.setdefault(k, []).append(i)
    return {p for ids in filed.values() for p in itertools.combinations(ids, 2)}, max(map(len, filed.values()))


def test_pairs_of_a_bucket_behind_another_head(spark):
    """Close pairs among pages of one template, the least id of whose buckets is mostly a third page; full buckets too."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, texts = some(138), [" ".join(some(50))]
    for _ in range(150):
        page = template + some(22)
        texts += [" ".join(page), " ".join(page[:-1] + some(1))]
    near = template + some(22)
    texts += [" ".join(near[:-1] + some(1)) for _ in range(80)] + [" ".join(near[: -rng.randint(15, 22)] + some(20)) for _ in range(60)]
    ids = list(range(1, len(texts)))
    rng.shuffle(ids)
    docs = list(zip([0, *ids], texts, strict=True))
    sets, (met, fullest) = whole_sets(docs), sharing(docs)
    assert fullest > 32
    got = {(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(docs, "doc_id long, text string"), 0.8).collect()}
    assert not [p for p in got if alike(sets[p[0]], sets[p[1]]) < 0.8]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[find(a)] = find(b)
    assert not [(a, b) for a, b in met if alike(sets[a], sets[b]) >= 0.8 and find(a) != find(b)]


def test_long_texts_at_exactly_the_threshold(spark):
    """Texts of 450 shingles that share 400 are similar to exactly 0.8 and link; those that share 399 don't."""
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for k in range(80):
        words = some(454)
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 404 - k % 2] + some(50 + k % 2)))]
    sets, (met, _) = whole_sets(docs), sharing(docs)
    wanted = {p for p in met if alike(sets[p[0]], sets[p[1]]) >= 0.8}
    below = {p for p in met if 0.79 < alike(sets[p[0]], sets[p[1]]) < 0.8}
    assert len(wanted) > 10 and len(below) > 10
    got = {(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(docs, "doc_id long, text string"), 0.8).collect()}
    assert got == wanted


def test_members_of_one_part_are_not_paired(spark, monkeypatch):
    """Copies of one part and a stranger in a full bucket make pairs in proportion to the copies, and all links are found."""
    made = []
    own = simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, sets, least: made.append(pairs.count()) or own(pairs, sets, least))
    for n in (200, 400):
        made.clear()
        # 100 shingles that all share, five of their own; the stranger shares half, the friend of another part nearly all.
        sets = [(k, list(range(100)) + [1000 + 5 * k + j for j in range(5)], 0) for k in range(n)]
        sets += [(n, list(range(50)) + list(range(10**6, 10**6 + 50)), 1), (n + 1, list(range(98)), 2)]
        full = spark.createDataFrame([(i, p) for i, _, p in sets], "name long, part long")
        links = simhash._meeting(full, spark.createDataFrame([(i, s) for i, s, _ in sets], "name long, shingles array<long>"), 0.8)
        got = {tuple(sorted((r.a, r.b))) for r in links.collect()}
        assert any(b == n + 1 for _, b in got) and not any(n in pair for pair in got)
        assert sum(made) <= 4 * n
