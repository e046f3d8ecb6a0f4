"""Token ids as packed binary files, written and read in parallel.

Documents are dealt into ranges of their ids. Each range is tokenised and written as segments (module ``rans``), one row
of a Parquet file each, so that the store's own commit protocol covers lost executors. A row holds the document ids and
lengths of whole documents, the frequency table, each block's checkpoint and checksum, and the blocks' words.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.cluster import fresh_path
from geoloom.llm import rans

END = 1
#: A segment ends with the document that fills it.
SEGMENT = 1 << 20
#: Bytes of text whose words are looked up together.
LOOKED_UP = 1 << 19
#: Pieces of words that a worker remembers with their ids, and those that go to the model in one text.
REMEMBERED, TOGETHER = 800_000, 128
#: Letters up to U+00FF, ASCII marks, and a word of letters with marks behind them.
LETTERS, MARKS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", string.punctuation
SHORT = f"^{LETTERS}*[!-/:-@\\[-`{{-~]*$"
#: A special token of the tokenizer, which parts what stands before and after it.
SPECIAL = "<|endoftext|>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _rows(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of a table of ids, one after the other, and where each of them ends."""
    lengths = (starts[1:] - starts[:-1])[which]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts[which] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


class Words(dict):
    """From pieces of words (UTF-8) to places in a table of ids, filled as pieces are met.

    Holds for tokenizers that lower-case, drop white space, and treat runs of letters and other runs apart, so that a
    text's ids are those of its words in order. A word of letters up to U+00FF with ASCII marks behind them, or of either
    alone, is two pieces, the letters in lower case and the marks: many words share them, and they go straight to the BPE
    model. Any other word is one piece, written with a space before it. Of those, letters go to the model, with a closing
    mark split off; the rest goes through the whole tokenizer. Beyond U+00FF only the tokenizer itself lower-cases: it
    composes characters before, and its special tokens are told apart by case.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        #: The same model, over pieces that are parted already.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.between = {b: c for b, c in self.letters.items() if b != ord(" ")}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.starts, self.pending = array("I"), array("q", [0, 0]), []
        self[b""] = 0

    def __missing__(self, piece: bytes) -> int:
        at = self[piece] = len(self)
        self.pending.append(piece)
        return at

    def _letters_only(self, word: str) -> list[int] | None:
        word = self.tokenizer.normalizer.normalize_str(word)
        if not word.isalpha():
            return None
        word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _whole(self, words: list[str]) -> list[list[int]]:
        """The ids of words by the whole tokenizer: in one text, parted by a special token, which nothing crosses."""
        special = self.tokenizer.token_to_id(SPECIAL)
        if special is None or any("<|" in w or "|>" in w for w in words):
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([SPECIAL.join(words)], add_special_tokens=False)[0].ids, np.int64)
        return [part[part != special].tolist() for part in np.split(ids, np.flatnonzero(ids == special))]

    def _words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words that aren't letters up to U+00FF and marks."""
        found, slow = [], []
        for raw in words:
            word, ids = raw.decode(), None
            if word.isalpha():
                ids = self._letters_only(word)
            elif word[:-1].isalpha() and word[-1] in MARKS:
                ids = self._letters_only(word[:-1])
                if ids is not None:
                    ids = ids + [t.id for t in self.tokenizer.model.tokenize(word[-1])]
            if ids is None:
                slow.append((len(found), word))
            found.append(ids)
        marked = [(k, w) for k, w in slow if "<|" in w or "|>" in w]
        plain = [(k, w) for k, w in slow if "<|" not in w and "|>" not in w]
        for some in (marked, plain):
            if some:
                for (k, _), ids in zip(some, self._whole([w for _, w in some]), strict=True):
                    found[k] = ids
        return found

    def _grow(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts.frombytes((len(self.flat) + np.cumsum(lengths, dtype=np.int64)).tobytes())
        self.flat.frombytes(ids.tobytes())

    def resolve(self) -> None:
        """Find the ids of the pieces met since the last time; those of letters or marks were met before whole words."""
        cut = next((k for k, p in enumerate(self.pending) if p.startswith(b" ")), len(self.pending))
        short, words = self.pending[:cut], [p[1:] for p in self.pending[cut:]]
        for i in range(0, len(short), TOGETHER):
            some = short[i : i + TOGETHER]
            text = b" ".join(some)
            text = text.decode() if text.isascii() else text.decode("latin-1").translate(self.between)
            coded = self.model.encode_batch([text], add_special_tokens=False)[0]
            self._grow(np.array(coded.ids, np.uint32), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some)))
        if words:
            found = self._words(words)
            self._grow(np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found]))
        self.pending.clear()

    def _places(self, pieces: pa.Array) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(pieces))

    def _pieces(self, words: pa.Array) -> np.ndarray:
        """The places of the two pieces of different words."""
        short = pc.match_substring_regex(words, SHORT)
        is_short = short.to_numpy(zero_copy_only=False)
        near = words.filter(short)
        stems = pc.ascii_rtrim(near, MARKS)
        marked = pc.not_equal(pc.binary_length(near), pc.binary_length(stems))
        tails = pc.replace_substring_regex(near.filter(marked), f"^{LETTERS}+", "")
        at = np.zeros((len(words), 2), np.int64)
        for k, where, pieces in ((0, is_short, pc.utf8_lower(stems)), (1, np.flatnonzero(is_short)[marked.to_numpy(zero_copy_only=False)], tails)):
            coded = pieces.dictionary_encode()
            at[where, k] = self._places(coded.dictionary)[coded.indices.to_numpy()]
        at[~is_short, 0] = self._places(pc.binary_join_element_wise("", words.filter(pc.invert(short)), " "))
        return at

    def encode(self, texts: list[str | None] | pa.Array, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id, and how many each text has."""
        if len(self) > remembered:
            self.forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        pieces = self._pieces(coded.dictionary)
        self.resolve()
        # A table of the different words, closed by a row for the end of a text.
        flat, ends = _rows(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64), pieces.ravel())
        flat, starts = np.append(flat, np.uint32(END)), np.concatenate(([0], ends[1::2], [len(flat) + 1]))
        closes = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
        place, inside = np.full(len(coded) + len(closes), len(pieces)), np.ones(len(coded) + len(closes), bool)
        inside[closes] = False
        place[inside] = coded.indices.to_numpy()
        ids, ends = _rows(flat, starts, place)
        return ids, np.diff(ends[closes], prepend=0)


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of under ``LOOKED_UP`` bytes of text behind the first row, which may have any length."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(upto // LOOKED_UP)) + 1).tolist(), batch.num_rows]
    return (batch.slice(i, k - i) for i, k in zip(cuts, cuts[1:], strict=False) if k > i)


def _row(ids: np.ndarray, names: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    s = rans.encode(ids)
    raw = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
    cells = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), raw(lengths, "<u4"), raw(s.symbols, "<u4"), raw(s.counts, "<u4"), raw(s.tokens, "<u4"), raw(s.words, "<u4"), raw(s.crcs, "<u4"), raw(s.states, "<u8"), raw(s.payload, "<u4")]
    return pa.RecordBatch.from_arrays([*cells, pa.array([len(ids)], pa.int64())], _COLUMNS)


_COLUMNS = ["ids", "lengths", "symbols", "counts", "tokens", "words", "crcs", "states", "payload", "n"]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, remembered: int = REMEMBERED) -> None:
    """Tokenise every whole text and write the ids, ascending by document id, below ``path``.

    Null texts count as empty and yield the end id alone. Null ids come first. Rows that share an id stay in the order
    of their texts' hash. An empty table writes no segment. The tokenizer's file must be at the same place everywhere.
    ``remembered`` pieces of words are kept in a worker with their ids: fewer take less memory and more time.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(tokenizer)
        parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        size = 0
        for whole in batches:
            for b in _slices(whole):
                ids, lengths = known.encode(b.column(1), remembered)
                parts.append((ids, b.column(0), lengths))
                size += len(ids)
                if size >= SEGMENT:
                    yield _row(np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
                    parts, size = [], 0
        if parts:
            yield _row(np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))

    rest = ", ".join(f"{c} binary" for c in _COLUMNS[1:-1])
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    own = own.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "text")
    own.mapInArrow(run, f"ids array<{kind}>, {rest}, n long").write.parquet(path)


def segment_of(row: dict) -> rans.Segment:
    """The segment that a row of a file holds."""
    a = {c: np.frombuffer(row[c], "<u8" if c == "states" else "<u4") for c in ("symbols", "counts", "tokens", "words", "crcs", "states", "payload")}
    return rans.Segment(**(a | {"states": a["states"].reshape(-1, rans.LANES)}))


def read_tokens(spark, path: str, kind: str = "bigint") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of each document, decoded from the files with all checksums verified.

    ``start`` counts the tokens of all documents before: the segments' totals are summed in the order of their first
    document, and lengths within them.
    """
    rest = ", ".join(f"{c} binary" for c in _COLUMNS[1:-1])
    files = spark.read.schema(f"ids array<{kind}>, {rest}, n long").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(i)[k].as_py() for i, c in enumerate(_COLUMNS) if c not in ("ids", "n")}
                names = b.column(0)[k].values
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ids = rans.decode(segment_of(row)).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                key = pa.array(np.full(len(names), b.column(len(_COLUMNS))[k].as_py()))
                yield pa.RecordBatch.from_arrays([key, names, pa.array(ends - lengths), pa.array(lengths), pa.array(np.array(crcs, np.int64))], ["segment", "id", "inside", "n_tokens", "ids_crc32"])

    # A segment is named by where its row stands: the file of its range and its place there.
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    named = files.select("*", F.xxhash64(at).alias("segment"))
    heads = files.select("n", F.get("ids", F.lit(0)).alias("first"), at.alias("at"))
    byfile = heads.groupBy("at.file").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.col("first").isNotNull().cast("int")).alias("known"))
    before = lambda *c: F.coalesce(F.sum("n").over(Window.orderBy(*c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    byfile = byfile.select("file", before("known", "first", "file").alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("at.file").orderBy("at.row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.xxhash64("at").alias("segment"), F.col("at.file").alias("file"), within.alias("within")).join(byfile, "file").select("segment", (F.col("within") + F.col("before")).alias("offset"))
    docs = named.mapInArrow(run, f"segment long, id {kind}, inside long, n_tokens long, ids_crc32 long")
    return docs.join(heads, "segment").select("id", (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write the files (below ``path``, or a fresh one in the shared folder) and read the table of documents back."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, tokenizer, remembered)
    out = read_tokens(docs.sparkSession, path, docs.schema[id_col].dataType.simpleString())
    return out.withColumnRenamed("id", id_col)
