"""Language-model scores of whole documents: a gated recurrent network and a smoothed unigram model.

Words are counted over the whole training corpus. The commonest, a fixed number, are sent to the executors; all others
meet their counts in a join. Texts become symbols once, and the network is trained in parallel over those of all
training documents, once each: documents are dealt by their hash into splits of about as many tokens, every split starts
from the same weights, and the weights are averaged by tokens, first over an eighth of the documents and then, from that
average, over the rest. How Spark partitions the rows changes nothing. Within the classes of uncommon words the
probability is by counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.cluster import written
from geoloom.llm import gru
from geoloom.llm.text import bucket

#: So many of the commonest words are known to every task.
COMMON = 1 << 18
#: Distinct words that a task counts before it passes them on, and symbols that it trains on or scores at a time.
COUNTED, CHUNK = 250_000, 1 << 20
#: Of eight parts of the training documents the first round takes one.
PARTS = 8
#: A split of the training documents has about so many tokens. Their weights are added in so many groups.
SPLIT, SUMS = 1 << 20, 16
#: Rows that a task works on at a time.
ROWS = 256


def words(text: str | None) -> list[bytes]:
    """Words parted by space and U+0009 to U+000D, as UTF-8, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def _class(word: bytes) -> int:
    """The class of a word outside the shortlist, by its first two bytes; words that begin alike share a language."""
    return zlib.crc32(word[:2]) % gru.TAIL


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c, k`` over ``text``: every word's count and its class. Counts are summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for t in b.column(0):
                tally.update(words(t.as_py()))
                if len(tally) > COUNTED:
                    yield flush()
                    tally.clear()
        yield flush()

    counts = docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return counts.withColumn("k", (F.crc32(F.substring("word", 1, 2)) % gru.TAIL).cast("int"))


class _Places(dict):
    """Numbers of words; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """The commonest words in order of count, and the sums that the formulas need."""

    common: list[bytes]
    counts: np.ndarray
    ends: int
    #: All training tokens, and how many different ones.
    tokens: int
    types: int
    #: Of each class of uncommon words: tokens and types.
    class_tokens: np.ndarray
    class_types: np.ndarray

    def __post_init__(self) -> None:
        self.ready = False

    def prepare(self) -> None:
        """What is made from the fields in each worker, once."""
        if self.ready:
            return
        short = gru.SHORT - 1
        self.places = _Places(zip(self.common, range(len(self.common)), strict=True))
        self.symbols = np.array([k + 1 if k < short else gru.SHORT + _class(w) for k, w in enumerate(self.common)], np.int32)
        self.log_counts = np.log10(self.counts + 0.5)
        # Words of the shortlist have all their probability from the network.
        self.rest = np.where(np.arange(len(self.common)) < short, 0.0, self.log_counts)
        self.log_class = np.log10(self.class_tokens + 0.5 * (self.class_types + 1))
        self.ready = True

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in self.__dataclass_fields__} | {"ready": False}

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """A text's symbols with the end, the places of its common words, and its other words."""
        ws = words(text)
        at = np.fromiter(map(self.places.__getitem__, ws), np.int32, len(ws))
        symbols = np.zeros(len(ws) + 1, np.int32)
        common = at >= 0
        symbols[:-1][common] = self.symbols[at[common]]
        other = [ws[k] for k in np.flatnonzero(~common).tolist()]
        if other:
            symbols[:-1][~common] = [gru.SHORT + _class(w) for w in other]
        return symbols, at[common], other

    def symbol_counts(self) -> np.ndarray:
        out = np.zeros(gru.SHORT + gru.TAIL)
        out[0] = self.ends
        out[1 : min(len(self.counts), gru.SHORT - 1) + 1] = self.counts[: gru.SHORT - 1]
        out[gru.SHORT :] = self.class_tokens
        return out


def vocabulary(counts: DataFrame, ends: int, common: int = COMMON) -> Vocabulary:
    """The words with at least that count at which no more than ``common`` have it."""
    steps = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    levels = steps.groupBy(F.least(F.floor(F.log2("c")), F.lit(62)).alias("level")).agg(F.sum("n").alias("n")).collect()
    # First by powers of two, which are few, then by the counts within the one that overflows.
    total, least = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        if total + r["n"] > common:
            inside = steps.where((F.col("c") >= 2 ** r["level"]) & (F.col("c") < 2 ** (r["level"] + 1))).limit(common).collect()
            least = 2 ** (r["level"] + 1)
            for s in inside:
                if total + s["n"] > common:
                    break
                total, least = total + s["n"], s["c"]
            break
        total += r["n"]
    top = counts if least is None else counts.where(F.col("c") >= least)
    got = top.select("word", "c").toArrow()
    listed, c = got.column("word").to_pylist(), got.column("c").to_numpy()
    order = sorted(range(len(listed)), key=lambda k: (-c[k], listed[k]))
    listed, c = [listed[k] for k in order], c[order].astype(float) if len(listed) else np.zeros(0)
    sums = {r["k"]: (r["c"], r["v"]) for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    n, v = (np.array([float(sums.get(k, (0, 0))[i]) for k in range(gru.TAIL)]) for i in (0, 1))
    tokens, types = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    for w, x in zip(listed[: gru.SHORT - 1], c, strict=False):
        n[_class(w)] -= x
        v[_class(w)] -= 1
    return Vocabulary(listed, c, ends, tokens, types, n, v)


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``docs`` (row, id, held_out, part, key, text) with, in place of ``text``, what training and scoring need of it.

    ``symbols`` are 16-bit numbers; ``base`` and ``rest`` the sums of the common words' logarithms in the two formulas;
    ``words`` and ``times`` the other words, which still have to meet their counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value
        vocab.prepare()
        end = np.log10(vocab.ends + 0.5)
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            tokens, base, known, rest, packed, others, times = [], [], [], [], [], [], []
            for t in b.column(len(kept)):
                symbols, at, other = vocab.encode(t.as_py())
                tokens.append(len(symbols))
                base.append(vocab.log_counts[at].sum() + end)
                known.append(len(at) + (vocab.ends > 0))
                rest.append(vocab.rest[at].sum() - vocab.log_class[symbols[symbols >= gru.SHORT] - gru.SHORT].sum())
                packed.append(symbols.astype("<u2").tobytes())
                tally = Counter(other)
                others.append(list(tally))
                times.append(list(tally.values()))
            made = [pa.array(tokens, pa.int64()), pa.array(base, pa.float64()), pa.array(known, pa.int64()), pa.array(rest, pa.float64()), pa.array(packed, pa.binary()), pa.array(others, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], [*[f.name for f in kept], "n_tokens", "base", "known", "rest", "symbols", "words", "times"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, f"{head}, n_tokens long, base double, known long, rest double, symbols binary, words array<binary>, times array<long>")


def _symbols(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<u2").astype(np.int32)


def trained(rows: DataFrame, tokens: int, start: gru.Params) -> gru.Params:
    """The average, by tokens, of the weights that each split of ``key, symbols`` reaches from ``start``.

    Splits, the order of documents within them, and the order in which weights are added follow from the rows alone.
    """
    sent = rows.sparkSession.sparkContext.broadcast(gru.packed(start))
    splits = max(1, -(-tokens // SPLIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, trainer, held, size = None, None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                trainer.train(held)
            if trainer is not None:
                yield pa.RecordBatch.from_arrays([pa.array([split], pa.int64()), pa.array([float(trainer.tokens)]), pa.array([gru.packed(trainer.p)], pa.binary())], ["split", "n", "p"])

        for b in batches:
            for now, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if now != split:
                    yield from done()
                    split, trainer, held, size = now, gru.Trainer(gru.unpacked(sent.value)), [], 0
                held.append(_symbols(cell))
                size += len(held[-1])
                if size >= CHUNK:
                    trainer.train(held)
                    held, size = [], 0
        yield from done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, total = None, 0.0, None
        for b in batches:
            for k in range(b.num_rows):
                own = b.column(1)[k].as_py()
                flat = np.frombuffer(b.column(2)[k].as_buffer(), "<f4").astype(float) * own
                first, n, total = b.column(0)[k].as_py() if first is None else first, n + own, flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["split", "n", "p"])

    dealt = rows.select(F.pmod("key", F.lit(splits)).alias("split"), "key", "symbols").repartition(splits, "split").sortWithinPartitions("split", "key", "symbols").select("split", "symbols")
    weights = dealt.mapInArrow(run, "split long, n double, p binary")
    # Weights have a fixed size; sums of sums keep what one task and the driver see to a few of them.
    sums = weights.repartition(SUMS, "split").sortWithinPartitions("split").mapInArrow(add, "split long, n double, p binary").collect()
    sums.sort(key=lambda r: r["split"])
    n = sum(r["n"] for r in sums)
    return gru.unpacked(sum(np.frombuffer(bytes(r["p"]), "<f8") for r in sums) / n) if n else start


def _modelled(batches: Iterator[pa.RecordBatch], p: gru.Params) -> Iterator[pa.RecordBatch]:
    """Rows with the network's log10-probability of the last column, their symbols, in its place; many at a time."""
    held, size = [], 0

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            model = gru.log_likelihoods(p, [_symbols(c) for c in whole.column("symbols")]) / np.log(10)
            yield from whole.drop_columns("symbols").append_column("model", pa.array(model)).to_batches()

    for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
        held.append(b)
        size += sum(len(c.as_buffer()) for c in b.column("symbols")) // 2
        if size >= CHUNK:
            yield from done()
            held, size = [], 0
    yield from done()


def scored(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``held_out`` is a condition on ``id_col``; the other rows train. Tokens are words and one end, so that null and
    blank texts have one token. ``base_score`` is the unigram log10-probability with a half added to each count and to
    all unknown words together; ``score`` the network's. Repeated rows train and score as often as they stand; without
    training rows all counts are 0. An empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), bucket(F.col(id_col), 5 * PARTS).alias("part"))
    train = own.where(~F.col("held_out"))
    counts = written(word_counts(train), "counts")
    vocab = vocabulary(counts, train.count(), common)
    rows = own.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", (F.floor(F.col("part") / 5) == 0).alias("early"), F.xxhash64("id", "text").alias("key"), "text")
    rows = written(encoded(rows, vocab), "encoded")
    params = gru.initial(vocab.symbol_counts())
    sizes = {r["early"]: r["n"] for r in rows.where(~F.col("held_out")).groupBy("early").agg(F.sum("n_tokens").alias("n")).collect()}
    for early in (True, False):
        if early in sizes:
            params = trained(rows.where(~F.col("held_out") & (F.col("early") == early)), sizes[early], params)
    sent = spark.sparkContext.broadcast(gru.packed(params))
    names = ["row", "id", "held_out", "n_tokens", "base", "known", "rest"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    model = rows.select(*names, "symbols").mapInArrow(lambda it: _modelled(it, gru.unpacked(sent.value)), f"{kinds}, model double")

    tail = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = tail.join(counts.select("word", "c"), "word", "left")
    sums = tail.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("met")
    )
    out = model.join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    spread = float(np.log10(vocab.tokens + 0.5 * (vocab.types + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * spread).alias("base_score"), (F.col("model") + F.col("rest") + logs).alias("score"),
    )
