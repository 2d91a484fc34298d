"""Concatenate and cut: tokens of all documents, one after another, cut into fixed windows.

Pass one tokenizes every text once and stores the ids with each document's offset inside its
input split; the splits' token totals are then prefix-summed, which gives every split its global
offset. Pass two needs no shuffle: a document's pieces follow from its global offset, and a
document that crosses a window boundary gives one record on each side.

A split is what one task reads of one place: tasks number the rows that they really see, whatever
exchanges the frame's plan has, and totals and offsets are written by the same tasks. Splits are
taken in the order of the tasks, or, where `place` names columns (such as `_metadata.file_path` of a
table just read), in the order of their values, so that a table written in mixing order is packed
in that order. One total per split reaches the driver.

Every window is full but the last; it is padded up to `window`, unless its length is a power of
two. Documents are never dropped, so padding is under one window for the whole corpus.

Defined results: a null text counts as empty and is the closing id alone; repeated rows and
ids are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.llm.text import BROADCAST_ROWS, byte_column, stored, tidy, word_pieces

WINDOW = 2048
END_ID = 1
#: Units of words, and words of rarer characters, kept by a worker; a full cache is emptied, and words go with their task.
CACHE_UNITS, CACHE_WORDS = 400_000, 100_000
LONG_WORD = 100

_STATE: dict = {}

#: Letters that lie in one run of letters whatever stands beside them: a-z and Latin-1's.
_LETTERS = rb"(?:[a-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_OTHER = re.compile(rb"'|[\xc4-\xff]|\xc2|\xc3[\x97\xb7]")
_UNIT = re.compile(_LETTERS + rb"|[^a-z\x80-\xff]+")
#: The units of a whole text that has nothing of _OTHER.
_RUN = re.compile(rb"[a-z\xc3\x80-\xbf]+|[^a-z\x80-\xff \t-\r]+")
#: A special token's start, or combining marks, which may join with a capital in another way.
_AS_IS = re.compile(rb"<\||\xcc|\xcd")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SHOWN = _byte_letters()


def words_of(text: bytes) -> list[bytes]:
    """White-space separated words, lower-cased where that cannot change a token.

    The tokenizer drops white space and ignores case. A text with a special token's start or
    with combining marks keeps its capitals.
    """
    return (text if _AS_IS.search(text) else text.lower()).split()


def default_tokenizer() -> str:
    """Path of the public word-level BPE vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Units(dict):
    """Ids by unit; those of a unit that is not there yet are found by `make`."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit: bytes) -> bytes:
        found = self.make(unit)
        if len(self) >= CACHE_UNITS:
            self.clear()
        if len(unit) <= LONG_WORD:
            self[unit] = found
        return found


class WordEncoder:
    """Ids of a text through a cache of its units' ids.

    A unit is a run of plain letters or of other ASCII characters; the tokenizer never merges over
    their borders, so most units are frequent. Texts with apostrophes or rarer characters are cut
    in words first, and words without those in units.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.cache: dict[bytes, bytes] = {}
        self.units = _Units(self.unit)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _STATE:
            _STATE[path] = cls(path)
        return _STATE[path]

    def unit(self, unit: bytes) -> bytes:
        """Ids of a run of plain letters, or of a run of other ASCII characters."""
        if unit[0] >= 0x80 or 0x61 <= unit[0] <= 0x7A:
            shown = unit.decode().lower()
            text = shown if shown.isascii() else "".join(map(_SHOWN.__getitem__, shown.encode()))
            ids = [t.id for t in self.tokenizer.model.tokenize(text)]  # one run, so no splitting is left to do
        else:
            ids = self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def word(self, word: bytes) -> bytes:
        """Ids of a word: by its units, or whole if it has an apostrophe or rarer characters."""
        if _OTHER.search(word) or _AS_IS.search(word) or word != word.lower():
            return array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.units.__getitem__, _UNIT.findall(word)))

    def encode(self, text: bytes) -> bytes:
        """Ids of a text, a piece of its words at a time."""
        return b"".join(map(self.piece, word_pieces(text)))

    def piece(self, text: bytes) -> bytes:
        if not (_OTHER.search(text) or _AS_IS.search(text)):
            return b"".join(map(self.units.__getitem__, _RUN.findall(text.lower())))
        words = words_of(text)
        missing = set(words).difference(self.cache)
        self.cache.update((w, self.word(w)) for w in missing)
        out = b"".join(map(self.cache.__getitem__, words))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        else:
            for w in missing:
                if len(w) > LONG_WORD:
                    del self.cache[w]
        return out


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, text: str = "text", place: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id, split, place, start, n, ids`: ids with the closing id, start counted inside the split."""
    path = tokenizer or default_tokenizer()
    parts = [F.lpad(F.col(c).cast("string"), 20, "0") if c.endswith("file_block_start") else F.col(c).cast("string") for c in place]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"), F.concat_ws("|", *parts).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        now, offset, split = None, 0, (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            ids, start, n, splits, places = [], [], [], [], batch.column("place").to_pylist()
            for at, t in zip(places, byte_column(batch, "t"), strict=True):
                if at != now:
                    now, offset, split = at, 0, split + 1
                ids.append(encoder.encode(t) + end)
                n.append(len(ids[-1]) // encoder.kind.itemsize)
                start.append(offset)
                splits.append(split)
                offset += n[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(splits, pa.int64()), batch.column("place"), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "split", "place", "start", "n", "ids"])
        encoder.cache.clear()

    return source.mapInArrow(tidy(run), "doc_id long, split long, place string, start long, n long, ids binary")


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, text: str = "text", place: tuple[str, ...] = ()) -> DataFrame:
    """One row for each piece of a document: where its ids start in it and where they lie.

    `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`, with `ids` as little-endian
    unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    ready = stored(tokenized(docs, path, end_id, text, place), "packing-ids")
    totals = ready.groupBy("split").agg(F.first("place").alias("place"), F.sum("n").alias("n"))
    bases, at = [], 0
    for _, split, n in sorted((r.place, r.split, r.n) for r in totals.collect()):  # one row per split
        bases.append((split, at))
        at += n
    offsets = spark.createDataFrame(bases, "split long, base long")
    if len(bases) <= BROADCAST_ROWS:  # beyond, a join on the split
        offsets = F.broadcast(offsets)
    placed = ready.join(offsets, "split").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = WordEncoder.of(path).kind
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, first, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype=kind).astype("<u4")
                a = 0
                while a < n:
                    sequence, offset = divmod(first + a, window)
                    length = min(n - a, window - offset)
                    own = ids[a : a + length].tobytes()
                    for column, v in zip(out, (doc, a, length, zlib.crc32(own), n, sequence, offset, own), strict=True):
                        column.append(v)
                    a += length
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], names=[*names, "ids"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names) + ", ids binary")


def padded_length(used: int, window: int = WINDOW) -> int:
    """Length that a sequence of `used` ids is padded to."""
    return used if used and used & (used - 1) == 0 else window
