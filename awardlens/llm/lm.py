"""Interpolated modified Kneser-Ney model of word triples, counted in Spark.

The model lives in the shared folder as sorted arrays that workers map into memory:

* words: for each shard, sorted 64-bit word hashes with their counts; a word's number is its
  place in the concatenation of the shards;
* triples: for each bucket, sorted 64-bit hashes of the triples seen twice or oftener, with counts;
* contexts of those triples: sorted keys (word number, word number), how often the context occurs
  and the share of it that is left to the word pairs;
* pairs: for each bucket, sorted keys (context number, word number), how often each pair occurs
  and how many different words it follows;
* for each word, what it precedes as a context (different triples' beginnings in total, and its
  followers with one, two, more of them) and how many different words it follows.

Every triple of the corpus is counted, in blocks that are aggregated inside a task before anything
is shuffled; a frequent triple is one entry for each block. Discounts and the lower orders take all
of them. Only in the stored arrays are triples seen once left out (STORED): their mass goes to the
word pairs, so probabilities still sum to one. A triple's bucket follows from its last two words,
those of very frequent words are spread: over pairs if the first of the two is frequent, over
triples if both are, whose pairs are then summed in a small step of their own. All arrays grow with
the corpus. Shards and buckets hold about SHARD_BYTES of text at every size, and each is gathered by
a task of its own. Counts are one byte, with a list of the larger ones; sums have 64 bits. Pair keys
hold two 32-bit word numbers, and training stops with an error at 2^32 distinct words. Triples are
told apart by 64-bit hashes, words too. The driver sees counts of counts and one row for each shard.

Tokens are lower-cased words and one end mark; two end marks are also the first word's context.

Defined results: a null text counts as empty (the end mark alone); repeated rows count and are
scored each; a null id counts as the empty text in the hold-out rule; with no training rows every
token has probability one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.llm.text import byte_column, drop_folder, is_held_out, mix, shared_folder, slices, tidy, word_hashes

END = np.uint64(0xE0D0F7E875A1D3B5)
SHARD_BYTES = 32 << 20
#: Arrays that a worker keeps mapped.
MAPPED = 1 << 14
#: Entries that a task gathers before it sends them on.
HELD = 2_000_000
#: Triples are stored from this count on; all are counted.
STORED = 2
#: Words below this count are never spread.
HOT_COUNT = 2000

# ------------------------------------------------------------------ arrays in the shared folder


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write whole and rename, so that a repeated task leaves the same file.

    Where a rename does not replace, the file of the earlier try, which is equal, stays.
    """
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    try:
        fs.move(part, f"{path}/{name}")
    except OSError:
        if not fs.get_file_info(f"{path}/{name}").is_file:
            raise
        fs.delete_file(part)


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def mapped(folder: str, name: str, kind: str, columns: int = 1) -> np.ndarray:
    """The array mapped into memory; from a remote folder through an unlinked local copy."""
    key = (folder, name)
    if key not in _MAPPED:
        if len(_MAPPED) > MAPPED:
            _MAPPED.clear()
        fs, path = pafs.FileSystem.from_uri(folder)
        size = fs.get_file_info(f"{path}/{name}").size
        if not size:
            found = np.zeros(0, dtype=kind)
        elif isinstance(fs, pafs.LocalFileSystem):
            found = np.memmap(f"{path}/{name}", dtype=kind, mode="r")
        else:
            with tempfile.NamedTemporaryFile(delete=False) as copy, fs.open_input_stream(f"{path}/{name}") as source:
                while block := source.read(8 << 20):
                    copy.write(block)
            found = np.memmap(copy.name, dtype=kind, mode="r")
            os.unlink(copy.name)
        _MAPPED[key] = found.reshape(-1, columns) if columns > 1 else found
    return _MAPPED[key]


def write_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """One byte each; 255 stands for an entry of the list of larger counts."""
    many = np.flatnonzero(counts >= 255)
    write_array(folder, f"{name}.n", np.minimum(counts, 255).astype("u1"))
    write_array(folder, f"{name}.at", many.astype("<i8"))
    write_array(folder, f"{name}.big", counts[many].astype("<i8"))


def read_counts(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    out = mapped(folder, f"{name}.n", "u1")[at].astype(np.int64)
    many = np.flatnonzero(out == 255)
    if len(many):
        out[many] = mapped(folder, f"{name}.big", "<i8")[np.searchsorted(mapped(folder, f"{name}.at", "<i8"), at[many])]
    return out


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which of the wanted ones are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


# ------------------------------------------------------------------ blocks of sorted counts


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _blocks(parts: Iterator[np.ndarray], bucket_of) -> Iterator[pa.RecordBatch]:
    """Counted keys of all parts as (bucket, keys, counts) rows, a block for each HELD entries."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def send() -> pa.RecordBatch:
        keys, counts = merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        bucket = bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cut[1:], len(keys)]
        rows = [(int(bucket[a]), keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for a, b in zip(cut, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "keys", "counts"])

    for part in parts:
        if len(part):
            k, c = np.unique(part, return_counts=True)
            held.append((k, c))
            n += len(k)
            if n > HELD:
                yield send()
                held, n = [], 0
    if held:
        yield send()


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.uint64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="<u4").astype(np.int64)
    return merged(keys, counts)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)


def triple_hash(pairs: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of the two last words' pair key and the word before them."""
    return mix(mix(pairs + np.uint64(1)) + before.astype(np.uint64))


def _packed(*columns: np.ndarray) -> bytes:
    """32-bit columns as byte planes, compressed."""
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, rows * columns * 4, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 4, rows).transpose(0, 2, 1)).view("<u4")[:, :, 0]


def _triple_blocks(parts: Iterator[tuple[np.ndarray, np.ndarray]], bucket_of) -> Iterator[pa.RecordBatch]:
    """Counted triples of all parts as (bucket, n, data) rows, a block for about each HELD occurrences."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def send() -> pa.RecordBatch:
        pairs, before = (np.concatenate(x) for x in zip(*held, strict=True))
        h = triple_hash(pairs, before)
        order = np.argsort(h)
        first = starts_of(h[order])
        counts, order = np.diff(first, append=len(h)), order[first]
        pairs, before, h = pairs[order], before[order], h[order]
        order = np.argsort(pairs)
        bucket = bucket_of(pairs[order], h[order])
        again = np.argsort(bucket, kind="stable")
        order, bucket = order[again], bucket[again]
        pairs, before, counts = pairs[order], before[order], counts[order]
        context, word = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [(s, b - a, _packed(np.diff(context[a:b], prepend=np.uint32(0)), word[a:b], before[a:b], counts[a:b])) for s, a, b in _runs(bucket)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "n", "data"])

    for pairs, before in parts:
        held.append((pairs, before))
        n += len(pairs)
        if n > HELD:
            yield send()
            held, n = [], 0
    if n:
        yield send()


def _gathered_triples(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples in hash order: hash, pair, word before, count."""
    parts = [_unpacked(d, n, 4) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
    context = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts]).astype(np.uint64)
    word, before, counts = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    parts.clear()
    pairs = (context << np.uint64(32)) | word
    h = triple_hash(pairs, before)
    order = np.argsort(h)
    first = starts_of(h[order])
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    order = order[first]
    return h[order], pairs[order], before[order].astype(np.int64), total


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their rows of values."""
    order = np.argsort(keys)
    first = starts_of(keys[order])
    return keys[order][first], np.add.reduceat(values[order], first, axis=0) if len(keys) else values


def _by_bucket(rows: DataFrame, buckets: int, make, schema: str) -> DataFrame:
    """`make(bucket, its rows)` for each bucket, each in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            for bucket in table.column("bucket").unique().to_pylist():
                yield from make(bucket, table.filter(pc.equal(table.column("bucket"), bucket))).to_batches()

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(run), schema)


# ------------------------------------------------------------------ the model


@dataclass
class Model:
    """What tasks need besides the mapped arrays."""

    folder: str
    bits: int
    sizes: np.ndarray  # words in each shard
    tokens: int
    hot: np.ndarray  # numbers of words whose pairs and triples are spread
    triple_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_types: int = 0
    rest: float = 1.0  # probability that the word level leaves to the uniform level

    @property
    def words(self) -> int:
        return int(self.sizes.sum())

    def offsets(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's word number, -1 where unknown."""
        distinct, back = np.unique(hashes, return_inverse=True)
        shard = _shard(distinct, self.bits)
        out = np.full(len(distinct), -1, dtype=np.int64)
        offset = self.offsets()
        for s, a, b in _runs(shard):
            known = mapped(self.folder, f"w{s}.key", "<u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == distinct[a:b], at + offset[s], -1)
        return out[back]

    def of_words(self, numbers: np.ndarray, name: str, kind: str, columns: int = 1) -> np.ndarray:
        """A per-word array's values at word numbers; zero for -1."""
        distinct, back = np.unique(numbers, return_inverse=True)
        shape = (len(distinct), columns) if columns > 1 else (len(distinct),)
        out = np.zeros(shape, dtype=np.int64)
        offset = self.offsets()
        known = int(np.searchsorted(distinct, 0))
        shard = np.searchsorted(offset, distinct[known:], side="right") - 1
        for s, a, b in _runs(shard):
            out[known + a : known + b] = mapped(self.folder, f"{name[0]}{s}.{name[1:]}", kind, columns)[distinct[known + a : known + b] - offset[s]]
        return out[back]

    def is_hot(self, numbers: np.ndarray) -> np.ndarray:
        return places(self.hot, numbers)[1]

    def is_spread(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs of two frequent words, whose triples lie in all buckets."""
        return self.is_hot(pairs >> np.uint64(32)) & self.is_hot(pairs & np.uint64(0xFFFFFFFF))

    def bucket_of(self, pairs: np.ndarray) -> np.ndarray:
        """A pair's bucket: by its context, for frequent contexts by the whole pair."""
        context = pairs >> np.uint64(32)
        context = np.where(self.is_hot(context), pairs, context)
        return _shard(mix(context + np.uint64(1)), self.bits)

    def triple_bucket(self, pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A triple's bucket: its pair's, for spread pairs by the whole triple."""
        return np.where(self.is_spread(pairs), _shard(hashes, self.bits), self.bucket_of(pairs))

    def pair_counts(self, pairs: np.ndarray, name: str) -> np.ndarray:
        """How often pair keys occur ("raw") or how many words they follow ("con")."""
        distinct, back = np.unique(pairs, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        spread = self.is_spread(distinct)
        for stem, which in (("p", np.flatnonzero(~spread)), ("q", np.flatnonzero(spread))):
            bucket = self.bucket_of(distinct[which])
            order = np.argsort(bucket, kind="stable")
            for s, a, b in _runs(bucket[order]):
                mine = which[order[a:b]]
                at, there = places(mapped(self.folder, f"{stem}{s}.key", "<u8"), distinct[mine])
                out[mine[there]] = read_counts(self.folder, f"{stem}{s}.{name}", at[there])
        return out[back]

    def contexts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often contexts of stored triples occur (0: none is stored) and the share left to the pairs."""
        distinct, back = np.unique(keys, return_inverse=True)
        bucket = self.bucket_of(distinct)
        order = np.argsort(bucket, kind="stable")
        total, left = np.zeros(len(distinct), dtype=np.int64), np.ones(len(distinct))
        for s, a, b in _runs(bucket[order]):
            mine = order[a:b]
            at, there = places(mapped(self.folder, f"x{s}.key", "<u8"), distinct[mine])
            total[mine[there]] = read_counts(self.folder, f"x{s}.all", at[there])
            left[mine[there]] = mapped(self.folder, f"x{s}.left", "<f8")[at[there]]
        return total[back], left[back]

    def triple_counts(self, pairs: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Counts of stored triples, 0 for others."""
        h = triple_hash(pairs, before)
        bucket = self.triple_bucket(pairs, h)
        order = np.lexsort((h, bucket))
        out = np.zeros(len(h), dtype=np.int64)
        for s, a, b in _runs(bucket[order]):
            mine = order[a:b]
            at, there = places(mapped(self.folder, f"t{s}.key", "<u8"), h[mine])
            out[mine[there]] = read_counts(self.folder, f"t{s}.all", at[there])
        return out


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of equal neighbours."""
    if len(values):
        cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        yield from zip(values[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(values)], strict=True)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, each text closed by END, and the tokens of each text."""
    h, n = word_hashes([t.lower() for t in texts])
    return np.insert(h, np.cumsum(n), END), n + 1


def _before(numbers: np.ndarray, count: np.ndarray, end: int, back: int) -> np.ndarray:
    """The number `back` places before each token; the end mark's before a text's first."""
    out = np.r_[np.full(back, end), numbers][: len(numbers)]
    first = np.cumsum(count) - count
    for k in range(back):
        out[first[count > k] + k] = end
    return out


def _pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and more from the numbers of types seen 1..4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def _less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)


class _Partials:
    """Rows (bucket, kind, at, values) that a bucket sends on.

    Kinds: 0 what words precede and 1 what they follow, for their shard; 2 counts of counts; 3 spread
    pairs and 4 contexts of stored triples, for their bucket. Values below 256 are bytes, the others
    have 64 bits (kind + 10).
    """

    SCHEMA = "bucket int, kind int, at binary, values binary"

    def __init__(self, model: Model):
        self.model, self.rows = model, []

    def _send(self, kind: int, bucket: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """Rows in order of their buckets."""
        small = values.reshape(len(values), -1).max(1) < 256
        for code, width, part in ((kind, "u1", small), (kind + 10, "<i8", ~small)):
            for x, a, b in _runs(bucket[part]):
                self.rows.append((x, code, at[part][a:b].tobytes(), values[part][a:b].astype(width).tobytes()))

    def words(self, kind: int, numbers: np.ndarray, values: np.ndarray) -> None:
        start = self.model.offsets()
        shard = np.searchsorted(start, numbers, side="right") - 1
        self._send(kind, shard, (numbers - start[shard]).astype("<u4"), values)

    def pairs(self, kind: int, keys: np.ndarray, values: np.ndarray) -> None:
        if len(keys):
            bucket = self.model.bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            self._send(kind, bucket[order], keys[order].astype("<u8"), values[order])

    def table(self, bucket: int, totals: list[int]) -> pa.Table:
        rows = [*self.rows, (bucket, 2, np.array(totals, dtype="<i8").tobytes(), b"")]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "at", "values"])


def _pair_rows(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of rows of kinds 3 and 4."""
    kinds, at, values = (table.column(c).to_pylist() for c in ("kind", "at", "values"))
    sums = [np.frombuffer(v, dtype="u1" if k < 10 else "<i8").astype(np.int64).reshape(-1, columns) for k, v in zip(kinds, values, strict=True)]
    return np.concatenate([np.frombuffer(a, dtype="<u8") for a in at]), np.concatenate(sums)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).alias("t"))


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count a model over all rows of `docs`."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "triple-model")
    rows = _texts(docs, text)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(0, (-(-size // SHARD_BYTES) - 1).bit_length())
    block = "bucket int, keys binary, counts binary"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (tokens_of(t[a:b])[0] for batch in batches for t in [byte_column(batch, "t")] for a, b in slices(t))
        yield from _blocks(parts, lambda k: _shard(k, bits))

    def word_shard(s: int, table: pa.Table) -> pa.Table:
        keys, counts = _gathered(table)
        write_array(folder, f"w{s}.key", keys.astype("<u8"))
        write_array(folder, f"w{s}.n", counts.astype("<i8"))
        top = np.argsort(-counts, kind="stable")[:64]
        top = top[counts[top] > HOT_COUNT]
        return pa.table({"bucket": pa.array([s], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()), "top": pa.array([top.tolist()], pa.list_(pa.int64())), "top_n": pa.array([counts[top].tolist()], pa.list_(pa.int64()))})

    found = _by_bucket(rows.mapInArrow(tidy(words), block), 1 << bits, word_shard, "bucket int, size long, tokens long, top array<long>, top_n array<long>").collect()  # a row per shard
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for r in found:
        sizes[r.bucket] = r.size
    model = Model(folder, bits, sizes, sum(r.tokens for r in found), np.zeros(0, dtype=np.uint64))
    for s in range(1 << bits):
        if not sizes[s]:
            write_array(folder, f"w{s}.key", np.zeros(0, "<u8"))
            write_array(folder, f"w{s}.n", np.zeros(0, "<i8"))
    if model.words >= 1 << 32:
        raise OverflowError("pair keys hold word numbers below 2^32")
    offset = model.offsets()
    limit = model.tokens / (8 << bits)
    model.hot = np.array(sorted(int(offset[r.bucket]) + i for r in found for i, n in zip(r.top, r.top_n, strict=True) if n > limit), dtype=np.uint64)
    sent = spark.sparkContext.broadcast(model)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        end = int(m.numbers(np.array([END]))[0])

        def parts():
            for batch in batches:
                t = byte_column(batch, "t")
                for a, b in slices(t):
                    h, n = tokens_of(t[a:b])
                    numbers = m.numbers(h)
                    yield _pair_keys(_before(numbers, n, end, 1), numbers), _before(numbers, n, end, 2).astype(np.uint32)

        yield from _triple_blocks(parts(), m.triple_bucket)

    def pair_arrays(out: _Partials, stem: str, s: int, keys: np.ndarray, raw: np.ndarray, con: np.ndarray) -> list[int]:
        """Write pairs, send what their words need; counts of counts and types."""
        write_array(folder, f"{stem}{s}.key", keys.astype("<u8"))
        write_counts(folder, f"{stem}{s}.raw", raw)
        write_counts(folder, f"{stem}{s}.con", con)
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = starts_of(context)
        if len(first):
            each = np.stack([con, con == 1, con == 2, con >= 3], axis=1).astype(np.int64)
            out.words(0, context[first], np.add.reduceat(each, first, axis=0))
            out.words(1, *np.unique(word, return_counts=True))
        return [*(int((con == k).sum()) for k in (1, 2, 3, 4)), len(keys)]

    def triple_bucket(s: int, table: pa.Table) -> pa.Table:
        m, out = sent.value, _Partials(sent.value)
        h, pairs, before, counts = _gathered_triples(table)
        stored = counts >= STORED
        write_array(folder, f"t{s}.key", h[stored].astype("<u8"))
        write_counts(folder, f"t{s}.all", counts[stored])
        c = counts[stored]
        keys = _pair_keys(before[stored], pairs[stored] >> np.uint64(32))
        out.pairs(4, *_summed(keys, np.stack([c, c == 1, c == 2, c >= 3], axis=1).astype(np.int64)))
        keys, sums = _summed(pairs, np.stack([counts, np.ones_like(counts)], axis=1))
        spread = m.is_spread(keys)
        out.pairs(3, keys[spread], sums[spread])
        seen = pair_arrays(out, "p", s, keys[~spread], sums[~spread, 0], sums[~spread, 1])
        return out.table(s, [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), *seen])

    def spread_bucket(s: int, table: pa.Table) -> pa.Table:
        out = _Partials(sent.value)
        keys, sums = _summed(*_pair_rows(table, 2))
        return out.table(s, [0, 0, 0, 0, *pair_arrays(out, "q", s, keys, sums[:, 0], sums[:, 1])])

    path, spread_path = shared_folder(spark, "triple-partials"), shared_folder(spark, "spread-partials")
    counted = rows.mapInArrow(tidy(triples), "bucket int, n int, data binary")
    _by_bucket(counted, 1 << bits, triple_bucket, _Partials.SCHEMA).write.parquet(path)
    partial = spark.read.schema(_Partials.SCHEMA).parquet(path)
    _by_bucket(partial.where("kind % 10 = 3"), 1 << bits, spread_bucket, _Partials.SCHEMA).write.parquet(spread_path)
    both = partial.unionByName(spark.read.schema(_Partials.SCHEMA).parquet(spread_path))
    totals = [np.frombuffer(r["at"], dtype="<i8") for r in both.where("kind = 2").select("at").collect()]  # two rows per bucket at most
    seen = np.sum(totals, axis=0).tolist() if totals else [0] * 9
    model.triple_discounts, model.pair_discounts, model.pair_types = _discounts(seen[:4]), _discounts(seen[4:8]), seen[8]
    ready = spark.sparkContext.broadcast(model)

    def context_bucket(s: int, table: pa.Table) -> pa.Table:
        m = ready.value
        keys, sums = _summed(*_pair_rows(table, 4))
        end = m.numbers(np.array([END]))
        # A context occurs as often as its pair, but for that of a text's first word.
        total = np.where(keys == _pair_keys(end, end)[0], m.of_words(end, "wn", "<i8")[0], m.pair_counts(keys, "raw"))
        write_array(folder, f"x{s}.key", keys.astype("<u8"))
        write_counts(folder, f"x{s}.all", total)
        write_array(folder, f"x{s}.left", (1 - (sums[:, 0] - sums[:, 1:] @ np.array(m.triple_discounts)) / total).astype("<f8"))
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    _by_bucket(partial.where("kind % 10 = 4"), 1 << bits, context_bucket, "n long").agg(F.sum("n")).collect()

    def word_stats(s: int, table: pa.Table) -> pa.Table:
        n = int(sent.value.sizes[s])
        context, before = np.zeros((n, 4), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for kind, at, values in zip(*(table.column(c).to_pylist() for c in ("kind", "at", "values")), strict=True):
            at, values = np.frombuffer(at, dtype="<u4"), np.frombuffer(values, dtype="u1" if kind < 10 else "<i8").astype(np.int64)
            if kind % 10 == 0:
                context[at] += values.reshape(-1, 4)
            else:
                before[at] += values
        write_array(folder, f"c{s}.n", context.astype("<i8"))
        write_array(folder, f"b{s}.n", before.astype("<i8"))
        return pa.table({"n": pa.array([[int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before >= 3).sum())]], pa.list_(pa.int64()))})

    stats = _by_bucket(both.where("kind % 10 < 2"), 1 << bits, word_stats, "n array<long>").collect()  # a row per shard
    drop_folder(spark, path)
    drop_folder(spark, spread_path)
    n = np.sum([r.n for r in stats], axis=0).tolist() if stats else [0] * 5
    model.word_discounts = _discounts(n[:4])
    if model.pair_types:
        d = model.word_discounts
        model.rest = (d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / model.pair_types
    return model


def log10_probabilities(m: Model, numbers: np.ndarray, context: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """log10 p(token | two words before it) of word numbers, -1 for unknown ones."""
    if not m.pair_types:
        return np.zeros(len(numbers))
    before = m.of_words(numbers, "bn", "<i8")
    word = _less(before, m.word_discounts) / m.pair_types + m.rest / (m.words + 1)
    stats = m.of_words(context, "cn", "<i8", 4)
    known = (numbers >= 0) & (context >= 0)
    count = np.zeros(len(numbers), dtype=np.int64)
    count[known] = m.pair_counts(_pair_keys(context[known], numbers[known]), "con")
    total = stats[:, 0]
    left = stats[:, 1:] @ np.array(m.pair_discounts)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(total > 0, (_less(count, m.pair_discounts) + left * word) / np.maximum(total, 1), word)
    at = np.flatnonzero((context >= 0) & (earlier >= 0))
    total, left = m.contexts(_pair_keys(earlier[at], context[at]))
    at, total, left = at[total > 0], total[total > 0], left[total > 0]
    p[at] *= left
    met = known[at]
    at, total = at[met], total[met]
    count = m.triple_counts(_pair_keys(context[at], numbers[at]), earlier[at])
    p[at] += _less(count, m.triple_discounts) / total
    return np.log10(p)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`doc_id, n_tokens, n_known, train_tokens, base_score, score` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        end = int(m.numbers(np.array([END]))[0])
        for batch in batches:
            texts = byte_column(batch, "t")
            out: list[list] = [[], [], [], []]
            for a, b in slices(texts):
                h, n = tokens_of(texts[a:b])
                numbers = m.numbers(h)
                count = m.of_words(numbers, "wn", "<i8")
                first = np.cumsum(n) - n
                base = np.log10((count + 1) / (m.tokens + m.words + 1))
                p = log10_probabilities(m, numbers, _before(numbers, n, end, 1), _before(numbers, n, end, 2))
                for column, v in zip(out, (n, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(p, first)), strict=True):
                    column.extend(v.tolist())
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"))
    found = source.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def with_perplexity(found: DataFrame) -> DataFrame:
    """Adds `perplexity`: 10 to the mean negative log10 probability of a token."""
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Train on the rows that are not held out, score all rows."""
    held = is_held_out(F.col("doc_id"), modulus, remainder)
    model = train(docs.where(~held))
    found = scored(docs, model).withColumn("held_out", held)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
