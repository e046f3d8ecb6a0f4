import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import rans, tokens
from tests.llm.conftest import awkward

#: Marks that compose only with small letters, special tokens in either case, and what else one word may hold.
COMPOSED = ["Y\u030a H\u0331 J\u030c W\u030a y\u030a Y\u030a. (Y\u030a) \u212b \u1e9e \u0130x I\u0307", "<|ENDOFTEXT|> a<|EndOfText|> <|endoftext|>x |> <| <|endof text|> (a) (b)", "A B C ab AB Ab aB a.B A.b A.B", "\u0130< \u0130. x\u0130, ab. Ab. AB, ab\u0307. \u00e9. \u00c9, \u00c9"]
TOUGH = ["it's I'LL don't ÉCOLE İstanbul ΣΑΣ x y foo.. a<|endoftext|>b <|startoftext|> 3.14 1,2 \x1c a\x85b é é ﬁ ½ it's, '' ''s 日本語、テスト。 ªº ǅ ß. naïve!", "\n\t", "don't."]


@given(st.lists(st.integers(0, 49_407), max_size=300))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (rans.decode(rans.encode(ids)) == ids).all()


@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.BLOCK, rans.BLOCK + 1, 5 * rans.BLOCK - 7])
def test_blocks_decode_alone(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 49_000).astype(np.uint32)
    s = rans.encode(ids)
    assert (rans.decode(s) == ids).all()
    last = len(s.tokens) - 1
    assert (rans.decode(s, last, last + 1) == ids[last * rans.BLOCK :]).all()
    assert s.payload.nbytes * 8 < 16 * n + 64 * rans.LANES


def test_damage_is_noticed():
    s = rans.encode((np.arange(70_000) % 977).astype(np.uint32))
    s.payload = s.payload.copy()
    s.payload[100] ^= 1
    with pytest.raises(ValueError):
        rans.decode(s)


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [[*e.ids, tokens.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + TOUGH + COMPOSED
    ids, lengths = tokens.Words(tokens.default_tokenizer()).encode(texts)
    want = whole(texts)
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@given(st.lists(st.text(st.sampled_from("aAyYiIsSßſKıİΣσ<|>endoftext'.,! \t\n\x1c\x85\u00a0\u3000\u030a\u0331\u0307\u0338日12")), max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text_gives_the_ids_of_whole_texts(texts):
    ids, lengths = tokens._words(tokens.default_tokenizer()).encode(texts)
    want = whole(texts)
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_words_that_share_letters_go_to_the_model_once():
    known = tokens.Words(tokens.default_tokenizer())
    letters, marks = ["house", "\u00e9t\u00e9", "stra\u00dfe", "tree"], ["", ".", ",", "***", "###", "!!"]
    texts = [" ".join(w + m for m in marks) for x in letters for w in (x, x.capitalize(), x[:-1] + x[-1].upper().replace("SS", "\u00df"))]
    ids, lengths = known.encode(texts)
    want = whole(texts)
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == [len(w) for w in want]
    assert len(known) <= len(letters) + len(marks)


def test_every_character_at_any_place_of_a_word():
    chars = [chr(c) for c in range(1, 0x250)]
    texts = [f for c in chars for f in (c, f"x{c}", f"{c}x", f"x{c}y", f"\u00c9{c}***", f"x***{c}", f"X {c} Y")]
    ids, lengths = tokens.Words(tokens.default_tokenizer()).encode(texts)
    want = whole(texts)
    assert [t for t, n, w in zip(texts, lengths.tolist(), want, strict=True) if n != len(w)] == []
    assert ids.tolist() == [i for w in want for i in w]


def test_forgetting_and_slices_change_no_ids(monkeypatch):
    texts = ["Some words, some marks***", None, "", "z" * 300, " \u65e5\u672c. <|endoftext|> it's ", None, "words again", "z" * 30] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    monkeypatch.setattr(tokens, "LOOKED_UP", 64)
    slices, known = list(tokens._slices(batch)), tokens.Words(tokens.default_tokenizer())
    assert len(slices) > 3 and pa.Table.from_batches(slices).combine_chunks() == pa.Table.from_batches([batch])
    assert list(tokens._slices(batch.slice(0, 0))) == []
    parts = [known.encode(s.column(1), remembered=5) for s in slices]
    want = whole(texts)
    assert [i for ids, _ in parts for i in ids.tolist()] == [i for w in want for i in w]
    assert [n for _, lengths in parts for n in lengths.tolist()] == [len(w) for w in want]


def test_files_round_trip(spark, odd_docs):
    path = f"file://{tempfile.mkdtemp()}/tokens"
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start), r.n_tokens, r.ids_crc32) for r in tokens.packed(odd_docs, path=path).collect())
    rows = [(i, t) for i, t, _ in awkward()]
    ids = dict(zip([t for _, t in rows], whole([t for _, t in rows]), strict=True))
    assert len(got) == len(rows)
    start = 0
    for (_, i, s), n, crc in got:
        match = [t for j, t in rows if (j or 0) == i and len(ids[t]) == n]
        assert s == start and crc in {zlib.crc32(np.array(ids[t], "<u4").tobytes()) for t in match}
        start += n
    assert [k[0][:2] for k in got] == sorted((i is not None, i or 0) for i, _ in rows)


def test_empty_table(no_docs):
    assert tokens.packed(no_docs).count() == 0
