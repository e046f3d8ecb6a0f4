import itertools
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from geoloom.llm import decontaminate, mixing, simhash, tokens
from tests.llm.test_simhash import components, plain_fingerprint


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["good_quality", "near_dedup", "decontamination", "mixture", "token_output"]
    seen = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "token_output":
            assert out.columns == docs.columns
        seen[name] = docs = corpus_pipeline.written(out, name)
    texts = {r.doc_id: r.text for r in seen["good_quality"].collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = [(i, plain_fingerprint(t)) for i, t in texts.items()]
    comp = dict(zip([i for i, _ in kept], components(kept).values(), strict=True))
    stay = {r.doc_id for r in seen["near_dedup"].collect()}
    # Nobody stays whom two bits join to a smaller one or who is clearly similar to another; nobody goes for nothing.
    assert stay <= set(comp.values())
    assert not [(a, b) for a, b in itertools.combinations(sorted(stay), 2) if alike(a, b) >= 0.88]
    assert not [a for a in set(comp.values()) - stay if max(alike(a, b) for b in texts if b != a) < 0.7]
    leaks = {r.doc_id for r in decontaminate.contained(seen["near_dedup"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in seen["decontamination"].collect()} == {r.doc_id for r in seen["near_dedup"].collect()} - leaks
    mixed = seen["mixture"].collect()
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(seen["decontamination"]).collect() if r.copies})
    assert Counter(r.doc_id for r in mixed) == copies
    # Token ids against the tokenizer on whole texts, in ascending order of the ids.
    rows, start = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in seen["token_output"].collect()), 0
    mixed.sort(key=lambda r: r.doc_id)
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    for r, e, got in zip(mixed, tokenizer.encode_batch([r.text or "" for r in mixed], add_special_tokens=False), rows, strict=True):
        ids = np.array([*e.ids, tokens.END], "<u4")
        assert got == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert simhash.LIMIT == 2


def test_the_session_is_left_as_it_was(spark, sf):
    before = spark.conf.get(corpus_pipeline.BATCH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    out = corpus_pipeline.good_quality(spark, docs, sf)
    assert spark.conf.get(corpus_pipeline.BATCH) == before and out.columns == docs.columns


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
