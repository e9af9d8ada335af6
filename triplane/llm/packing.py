"""Packing by powers of two.

A document of n tokens is split by the binary digits of n: whole sequences of the longest length first, then one piece
for each further digit that is set. Each piece is a sequence by itself, of a power-of-two length, so nothing is padded and
no sequence crosses documents; pieces of equal length form the buckets from which batches are drawn.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm.common import give_back, small_batches, table

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 700_000
#: Bytes of text that a worker tokenizes at a time, but for a longer text, which it takes alone.
AT_ONCE = 5_000_000
#: Pieces in a batch that goes back to Spark.
PIECES = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def cuts(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first: powers of two, of sum n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class WordIds:
    """Ids of the words of texts.

    The tokenizer drops white space, and no rule of it looks across white space or between a letter and a full stop or
    comma, so texts may be cut there and each distinct word tokenized once. ASCII letters are lowered first, as it does.
    """

    _LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
    _LETTER = np.array([97 <= b <= 122 for b in range(256)])
    _STOP = np.array([b in b".," for b in range(256)])

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.bytes = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.lengths, self.starts = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, word: str) -> list[int]:
        if word.isalpha() and word.islower() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            if not word.isascii():  # what normalizing and splitting leave as it is goes to the model as byte letters
                word = "".join([self.bytes[b] for b in word.encode()])
            return [t.id for t in self.model.tokenize(word)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and where each text's begin and end."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = self._LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        cut = np.flatnonzero(self._STOP[data[1:]] & self._LETTER[data[:-1]]) + 1
        data, offsets = np.insert(data, cut, 32), offsets + np.searchsorted(cut, offsets).astype(np.int32)
        lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data)))
        return lists.values, np.asarray(lists.offsets)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; none for null."""
        found, ends = self._words(pc.fill_null(texts, ""))
        place = pc.index_in(found, self.known)
        if place.null_count:
            if len(self.known) > REMEMBERED:
                self._forget()
                place = pa.nulls(len(found), pa.int32())
            missing = found.filter(place.is_null())
            fresh = missing.unique().filter(pc.not_equal(missing.unique(), ""))
            each = [self._ids(w) for w in fresh.to_pylist()]
            fresh, each = pa.concat_arrays([fresh, pa.array([""])]), [*each, []]  # splitting leaves empty words at ends
            at = len(self.known)
            self.known = pa.concat_arrays([self.known, fresh])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, each), np.int64, len(each))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(each), "<u4")])
            self.starts = np.cumsum(self.lengths) - self.lengths
            new = pc.index_in(missing, fresh).to_numpy() + at
            place = place.fill_null(-1).to_numpy().copy()
            place[place < 0] = new
        else:
            place = place.to_numpy()
        n = self.lengths[place]
        last = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[place] - (last - n), n) + np.arange(last[-1] if len(last) else 0)]
        bounds = np.concatenate([[0], last])[ends]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _runs(texts: pa.Array, budget: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about ``budget`` bytes in all; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > budget:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def pack(docs: DataFrame, longest: int = 2048, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Rows ``doc_id, start, length, doc_tokens, ids, sequence_id, offset, bucket``: one per piece.

    bucket: the logarithm of the length to base 2; pieces of a bucket are all of one length and make batches without padding.

    ids: the piece's token ids as little-endian 32-bit integers. A null or empty text has the end id alone. Texts are
    tokenized whole; repeated rows and repeated or null ids are packed as separate documents, in sequences of their own.
    An empty table gives no rows. Only ``doc_id`` and ``text`` are read. ``longest`` must be a power of two. Sequence ids
    hold the partition and the place in it, so a task that runs again gives the same ones.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    vocabulary = vocabulary or default_vocabulary()
    last = np.array([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(vocabulary)
        for batch in batches:
            texts, doc_ids = batch.column(1), batch.column(0)
            for a, b in _runs(texts, AT_ONCE):
                out: list[list] = [[], [], [], [], []]
                for k, ids in enumerate(ids_of(texts.slice(a, b - a)), a):
                    raw, n, at = ids.tobytes() + last, len(ids) + 1, 0
                    for length in cuts(n, longest):
                        for column, value in zip(out, (k, at, length, n, raw[4 * at : 4 * (at + length)]), strict=True):
                            column.append(value)
                        at += length
                for i in range(0, len(out[0]), PIECES):
                    rows, start, length, n, raw = (c[i : i + PIECES] for c in out)
                    yield pa.record_batch(
                        [doc_ids.take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())],
                        names=["doc_id", "start", "length", "doc_tokens", "ids"],
                    )
        del ids_of
        give_back()

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = slim.mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return packed.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place, a checksum of its token ids, and its sequence."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
