"""Small helpers that several corpus operators share: byte words, rolling hashes, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker holds as numpy arrays at a time.
SLICE_BYTES = 2 << 20
#: Rows of a small table (a few hundred bytes each) that are still broadcast.
BROADCAST_ROWS = 200_000


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty texts."""
    values = batch.column(name).cast(pa.large_binary()).to_pylist()
    return [v or b"" for v in values]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back when it ends, since workers live on between stages."""

    def ended(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where there is no such C library
                ctypes.CDLL(None).malloc_trim(0)

    return ended


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (one row at least)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer that spreads every input bit (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


#: Bytes of text that are hashed at a time, however long a text or a word is.
PIECE = 1 << 18
_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(_INV, PIECE + 1)


_BLANK = re.compile(rb"[ \t-\r]")
#: Bytes of a text whose words are held as objects at a time.
WORD_BYTES = 1 << 20


def word_pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about WORD_BYTES, cut at white space."""
    at = 0
    while len(text) - at > WORD_BYTES:
        cut = _BLANK.search(text, at + WORD_BYTES)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space separated words, and the words of each text.

    Words are runs of bytes other than space and 0x09-0x0D. A word's hash is a rolling polynomial
    over random byte values, so that one cumulative sum gives all of a piece. Pieces have PIECE
    bytes; a word that crosses pieces is put together from its parts, so what is held besides the
    text is a few words of memory for each of its words.
    """
    data = b" ".join(texts) + b" "
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    whole, size, begin = [], [], []
    part, part_size, part_start = 0, 0, -1  # an unfinished word: its polynomial, length and start
    for at in range(0, len(data), PIECE):
        buffer = np.frombuffer(data, dtype=np.uint8, count=min(PIECE, len(data) - at), offset=at)
        edge = np.flatnonzero(np.diff(_SPACE[buffer], prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        if len(ends) < len(starts):
            ends = np.r_[ends, len(buffer)]
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buffer] * _UP[: len(buffer)], out=sums[1:])
        value, length, first = (sums[ends] - sums[starts]) * _DOWN[starts], (ends - starts).astype(np.uint64), starts + at
        if part_start >= 0:
            if len(starts) and starts[0] == 0:
                value[0] = np.uint64((part + int(value[0]) * pow(_BASE, part_size, 1 << 64)) % (1 << 64))
                length[0] += np.uint64(part_size)
                first[0] = part_start
            else:
                value, length, first = np.r_[np.uint64(part), value], np.r_[np.uint64(part_size), length], np.r_[part_start, first]
            part_start = -1
        if len(ends) and ends[-1] == len(buffer) and not _SPACE[buffer[-1]]:
            part, part_size, part_start = int(value[-1]), int(length[-1]), int(first[-1])
            value, length, first = value[:-1], length[:-1], first[:-1]
        whole.append(value)
        size.append(length)
        begin.append(first)
    hashes = mix(np.concatenate(whole) + np.concatenate(size))
    bounds = np.searchsorted(np.concatenate(begin), np.cumsum(lengths))
    return hashes, np.diff(bounds, prepend=0)


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` lower-cased words of all texts in order, and how many each text has.

    A text of fewer words is one shingle; a text without words has none.
    """
    h, count = word_hashes([t.lower() for t in texts])
    first = np.cumsum(count) - count
    own = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    at = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())
    end = np.repeat(first + count, own)
    padded = np.r_[h, np.zeros(size, dtype=np.uint64)]
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out = np.where(at + k < end, mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]), out)
    return out, own


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it is unset, one of our own in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root or "file:///tmp/checkpoints/awardlens"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame as Parquet under the shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_held_out(doc_id, modulus: int, remainder: int):
    """Column: crc32 of the id as text leaves `remainder`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus) == remainder


def row_of(df: DataFrame) -> Column:
    """All input columns as one struct, so that no helper column can clash with them."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"
