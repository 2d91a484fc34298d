"""SimHash near-duplicates by a binary-trie self-join over fingerprints.

Fingerprints are the bits set in over half of the shingle hashes. Distinct fingerprints are
joined with themselves as binary tries: node pairs descend together one bit at a time, carry
the bits that differ so far, and are dropped once an error budget is exceeded. By the
pigeonhole principle one of `blocks` bit blocks of a linked pair differs in few bits, so the
trie is walked once per block, with that block's bits first and a small budget on them.

Defined results: a null text counts as empty; a text without words has fingerprint zero and
links like any other; exact copies share one trie leaf; repeated ids share a component; null
ids are kept and never are the smallest id of a component that has another; an empty table
gives an empty result; keep_one_of_each carries all other columns along, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardlens.llm.components import components
from awardlens.llm.leaders import led
from awardlens.llm.text import byte_column, mix, row_of, shingles, slices, stored, tidy, word_pieces

#: Hashes whose bits are counted at a time.
HELD = 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of `size` space-joined lower-cased words, repeats included."""
    parts, words = [], []
    for piece in word_pieces(text):
        words += piece.lower().split()
        if len(words) >= size:
            joined = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
            parts.append(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), dtype=np.uint64, count=len(words) - size + 1))
            words = words[len(words) - size + 1 :]
    if parts:
        return np.concatenate(parts)
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    if n > 400:
        ones = 0
        for at in range(0, n, HELD):
            parts = hashes[at : at + HELD].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones = ones + np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
    else:
        ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, size: int = 3) -> tuple[int, int]:
    """The 64-bit fingerprint of a text over XXH64, repeats included, and its shingle count."""
    h = shingle_hashes(text, size)
    return majority(h), len(h)


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text") -> DataFrame:
    """`doc_id, text_hash, fp, n_shingles`: fp has 16 hex digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, size) for t in byte_column(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([f"{f:016x}" for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "text_hash", "fp", "n_shingles"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("text_hash"))
    return source.mapInArrow(tidy(run), "doc_id long, text_hash long, fp string, n_shingles long")


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for a, b in slices(texts):
        h, count = shingles(texts[a:b], size)
        end = np.cumsum(count)
        for n, e in zip(count.tolist(), end.tolist(), strict=True):
            yield np.unique(h[e - n : e])


def set_fingerprint(distinct: np.ndarray, words: int) -> str:
    """`words` 64-bit fingerprints of a shingle set, then a hash of the set, as hex digits.

    The last word keeps texts of unlike shingles apart although their fingerprints are equal.
    """
    found = [majority(mix(distinct + np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64)))) for k in range(words)]
    return "".join(f"{x:016x}" for x in (*found, int(mix(distinct).sum(dtype=np.uint64))))


def set_fingerprints(docs: DataFrame, size: int = 5, words: int = 4) -> DataFrame:
    """`doc_id, text_hash, fp, n_shingles` over the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_fingerprint(u, words), len(u)) for u in shingle_sets(byte_column(batch, "t"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "text_hash", "fp", "n_shingles"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"), F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(tidy(run), "doc_id long, text_hash long, fp string, n_shingles long")


# ------------------------------------------------------------------ trie join inside a task


@dataclass(frozen=True)
class Budget:
    """`bits` differing at most `errors` places; budgets are nested prefixes of the fingerprint."""

    bits: int
    errors: int


class Links:
    """A union-find over leaf numbers that takes whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        while len(a := a[keep := a != b]):
            b = b[keep]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := self.root[self.root], self.root):
                self.root = jumped
            a, b = self.root[a], self.root[b]


def _rotated(fps: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """The first word's bits turned so that block `block` of `blocks` comes first."""
    shift = np.uint64(block * (64 // blocks))
    if not shift:
        return fps
    out = fps.copy()
    out[:, 0] = (fps[:, 0] << shift) | (fps[:, 0] >> (np.uint64(64) - shift))
    return out


def trie_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, first: Budget, totals: tuple[Budget, ...], frontier: int = 1 << 15) -> np.ndarray:
    """For each fingerprint row the smallest row it is linked with, itself included.

    fps: (n, words) already rotated. group: rows of different groups never meet. side: 0 for
    rows that meet each other, or, where a group has both, rows of side 0 meet side 1 alone.
    """
    n = len(fps)
    links = Links(n)
    order = np.lexsort((*(fps[:, k] for k in reversed(range(fps.shape[1]))), side, group))
    fps, g, s = fps[order], group[order], side[order]
    cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]), True]) if n else np.zeros(1, dtype=np.int64)
    lo, hi = cut[:-1], cut[1:]
    paired = np.r_[(g[lo[1:]] == g[lo[:-1]]), False] if len(lo) else np.zeros(0, dtype=bool)
    second = np.r_[False, paired[:-1]] if len(lo) else paired
    alone = ~paired & ~second & (s[lo] == 0) if len(lo) else paired
    i, j = np.flatnonzero(paired), np.flatnonzero(paired) + 1
    a = np.r_[lo[alone], lo[i]], np.r_[hi[alone], hi[i]]
    b = np.r_[lo[alone], lo[j]], np.r_[hi[alone], hi[j]]
    depth_limit = totals[0].bits

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), frontier):
            p, q = x[at : at + frontier], y[at : at + frontier]
            for t in totals:
                d = np.bitwise_count(fps[p, : t.bits // 64] ^ fps[q, : t.bits // 64]).sum(1)
                p, q = p[d <= t.errors], q[d <= t.errors]
            links.add(order[p], order[q])

    def ranges(alo, na, blo, nb):
        size = na * nb
        at = np.repeat(np.cumsum(size) - size, size)
        k = np.arange(size.sum()) - at
        w = np.repeat(nb, size)
        return np.repeat(alo, size) + k // w, np.repeat(blo, size) + k % w

    ones = {}
    stack = [(0, a[0], a[1], b[0], b[1], np.zeros(len(a[0]), dtype=np.int16))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > frontier:
            half = len(alo) // 2
            for sl in (slice(half, None), slice(0, half)):
                stack.append((depth, alo[sl], ahi[sl], blo[sl], bhi[sl], err[sl]))
            continue
        same = alo == blo
        na, nb = ahi - alo, bhi - blo
        keep = (na > 0) & (nb > 0) & ~(same & (na == 1)) & (err <= (first.errors if depth <= first.bits else totals[0].errors))
        small = keep & (na * nb <= 16)
        if small.any():
            x, y = ranges(alo[small], na[small], blo[small], nb[small])
            verify(x[x != y], y[x != y])
        keep &= ~small
        if not keep.any():
            continue
        alo, ahi, blo, bhi, err, same = (v[keep] for v in (alo, ahi, blo, bhi, err, same))
        if depth == depth_limit:  # equal or near in all of the first word: compare the rest in bounded pieces
            for k in range(len(alo)):
                for r in range(alo[k], ahi[k]):
                    y = np.arange(max(r + 1, blo[k]) if same[k] else blo[k], bhi[k])
                    verify(np.full(len(y), r), y)
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((fps[:, 0] >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        c = ones[depth]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        cross = ~same
        stack.append(
            (
                depth + 1,
                np.r_[alo, am, alo, am[cross]],
                np.r_[am, ahi, am, ahi[cross]],
                np.r_[blo, bm, bm, blo[cross]],
                np.r_[bm, bhi, bhi, bm[cross]],
                np.r_[err, err, err + 1, err[cross] + 1],
            )
        )
    return links.root


def node_name(low, fp):
    """A name that sorts by a fingerprint's smallest id (none last) and ends with the fingerprint.

    The smallest name of a component then tells its smallest id, without a further grouping.
    """
    shifted = (low.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.concat(F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit("~" * 20)), fp)


def id_of(name):
    """The id that a node's name begins with, null for none."""
    shifted = F.when(F.substring(name, 1, 1) != "~", F.substring(name, 1, 20))
    return (shifted.cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """A row's key by its id and its text's hash; never null."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), text_hash.cast("string"))


def nodes_of(prints: DataFrame) -> DataFrame:
    """`name, fp, n_shingles` of the distinct fingerprints, and the `key` of the row with the smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x") if "text_hash" in prints.columns else F.min(F.struct("doc_id")).alias("x")
    grouped = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("n_shingles").alias("n_shingles"), first)
    key = [row_key(F.col("x.doc_id"), F.col("x.text_hash")).alias("key")] if "text_hash" in prints.columns else []
    return stored(grouped.select(node_name(F.col("low"), F.col("fp")).alias("name"), "fp", "n_shingles", *key), "fingerprint-nodes")


NODE = ["block", "level", "prefix"]

#: Rows of one side of a task; a worker holds about twice as many at a time.
TASK_ROWS = 1 << 16


def dealt(rows: DataFrame, masks: list[int], classes: int = 0, cap: int = TASK_ROWS) -> DataFrame:
    """`task, side, block, name`: every row once for each task in which its trie node takes part.

    rows: `name, block, level, prefix`; the rows of one block, class and prefix are a node of the
    upper trie. A node meets itself and the nodes of its own and the next `classes` classes whose
    prefix differs by one of `masks`. A node of over `cap` rows is cut in pieces by a hash, and its
    pieces meet pairwise, so a hot node only means more tasks. Nodes and their meetings are tables;
    the driver sees none of them, and a node that meets nothing sends no row.
    """
    nodes = rows.groupBy(*NODE).agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / cap).cast("int"))
    nodes = stored(nodes, "trie-nodes")
    mask = F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))
    ahead = nodes.select(*NODE, "n", "pieces", mask.alias("mask")).withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(classes))))
    ahead = ahead.withColumn("level_b", F.col("level") + F.col("up")).withColumn("prefix_b", F.col("prefix").bitwiseXOR(F.col("mask")))
    itself = (F.col("up") == 0) & (F.col("mask") == 0)
    ahead = ahead.where((F.col("up") > 0) | (F.col("prefix_b") >= F.col("prefix"))).where(~itself | (F.col("n") > 1))
    other = nodes.select("block", F.col("level").alias("level_b"), F.col("prefix").alias("prefix_b"), F.col("pieces").alias("pieces_b"))
    met = ahead.join(other, ["block", "level_b", "prefix_b"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.withColumn("y", F.explode(F.sequence(F.when(itself, F.col("x")).otherwise(0), F.col("pieces_b") - 1)))
    met = met.withColumn("alone", itself & (F.col("x") == F.col("y")))
    met = stored(met.select(*NODE, "level_b", "prefix_b", "x", "y", "alone", F.monotonically_increasing_id().alias("task")), "trie-meetings")
    left = met.select(*NODE, F.col("x").alias("piece"), "task", F.lit(0).alias("side"))
    right = met.where("NOT alone").select("block", F.col("level_b").alias("level"), F.col("prefix_b").alias("prefix"), F.col("y").alias("piece"), "task", F.lit(1).alias("side"))
    cut = rows.join(nodes.select(*NODE, "pieces"), NODE).withColumn("piece", F.pmod(F.xxhash64("name"), F.col("pieces").cast("long")).cast("int"))
    return cut.join(left.unionByName(right), [*NODE, "piece"]).select("task", "side", "block", "name")


def whole_tasks(batches: Iterator[pa.RecordBatch], least: int = TASK_ROWS) -> Iterator[pa.Table]:
    """Tables of whole tasks, of `least` rows or one task each, from batches sorted by task."""
    held, size = [], 0
    for batch in batches:
        task = batch.column("task").to_numpy()
        edges = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)] if len(task) else [0]
        last = held[-1].column("task")[-1].as_py() if held else None
        start = 0
        for at in edges[:-1]:
            if size + at - start >= least and (at or task[0] != last):
                yield pa.Table.from_batches([*held, batch.slice(start, at - start)])
                held, size, start = [], 0, at
        if start < len(task):
            held.append(batch.slice(start))
            size += len(task) - start
    if held:
        yield pa.Table.from_batches(held)


def _joined(rows: DataFrame, words: int, blocks: int, first: Budget, totals: tuple[Budget, ...]) -> DataFrame:
    """`src, dst` names linked among `task, side, block, name` rows; a worker walks a few tasks' tries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            names = table.column("name").to_pylist()
            raw = np.frombuffer(bytes.fromhex("".join(n[20 : 20 + 16 * words] for n in names)), dtype=">u8").astype(np.uint64).reshape(-1, words)
            block, task, side = (table.column(c).to_numpy() for c in ("block", "task", "side"))
            turned = raw.copy()
            for k in range(blocks):
                turned[block == k] = _rotated(raw[block == k], k, blocks)
            root = trie_links(turned, task, side, first, totals)
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array([names[i] for i in root[at]], pa.string())], names=["src", "dst"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(tidy(run), "src string, dst string").where("src <> dst").distinct()


def _first_bits(block: int, width: int, depth: int):
    """Column: the first `depth` bits of a block of a fingerprint's first word."""
    word = F.conv(F.substring("fp", 1, 16), 16, -10).cast("long")
    return F.shiftrightunsigned(F.shiftleft(word, block * width), 64 - depth) if depth else F.lit(0).cast("long")


def _by_block(nodes: DataFrame, level, blocks: int, depth: int) -> DataFrame:
    """`name, block, level, prefix` of every fingerprint, once for each block."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), _first_bits(k, 64 // blocks, depth).alias("prefix")) for k in range(blocks))))
    return nodes.select("name", level.alias("level"), each.alias("b")).select("name", "b.block", "level", "b.prefix")


def hamming_links(nodes: DataFrame, errors: int = 3, blocks: int = 4, cap: int = TASK_ROWS) -> DataFrame:
    """Spanning links of all 64-bit fingerprints at `errors` or fewer differing bits; exact.

    With errors < blocks some block is equal, so the tries of a block's values are walked each by
    itself: they hold the fingerprints that share those bits. Two fingerprints of a component are
    joined by a path of links, though not by every link.
    """
    assert errors < blocks and 64 % blocks == 0
    width = 64 // blocks
    rows = _by_block(nodes, F.lit(0), blocks, width)
    return _joined(dealt(rows, [0], cap=cap), 1, blocks, Budget(width, 0), (Budget(64, errors),))


def linked_classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`fp, root, component_id`: the smallest name and id of the class of linked fingerprints."""
    roots = components(links).withColumnRenamed("node", "name")
    named = nodes.select("name", "fp").join(roots, "name", "left")
    root = F.coalesce("root", "name")
    return named.select("fp", root.alias("root"), id_of(root).alias("component_id"))


def near_components(docs: DataFrame, size: int = 3, errors: int = 3) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row: the smallest id reachable over links."""
    prints = stored(fingerprints(docs, size).select("doc_id", "fp", "n_shingles"), "fingerprints")
    nodes = nodes_of(prints)
    classes = linked_classes(nodes, hamming_links(nodes, errors))
    return prints.select("doc_id", "fp").join(classes, "fp").select("doc_id", F.col("fp").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


# ------------------------------------------------------------------ near copies of five-word shingles


def expected_errors(similarity: float, bits: int) -> float:
    """Differing bits expected at a Jaccard similarity: bits * angle / pi, cosine = 2J / (1 + J)."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def similarity_links(nodes: DataFrame, similarity: float = 0.8, words: int = 4, blocks: int = 4, cap: int = TASK_ROWS) -> DataFrame:
    """Spanning links of fingerprints whose estimated Jaccard similarity reaches `similarity`.

    nodes: `name, fp, n_shingles`. Budgets are the expected differing bits plus two standard
    deviations: over the first 64 bits and over all `64 * words`. n_shingles counts distinct
    shingles, and a pair of that similarity lies in one class of counts or in neighbouring ones. The
    upper levels of the trie are walked by Spark: a class of over `cap` fingerprints is cut in the
    trie's nodes at the depth where nodes have about `cap`, and node pairs beyond the leading
    block's budget never meet. So a fingerprint is sent to as many tasks as there are prefixes
    within the budget (697 of 65,536 at most for each block and class), besides pieces of hot nodes.
    """
    deviation = lambda p, n: math.sqrt(n * p * (1 - p))
    p = expected_errors(similarity, 1)
    near = math.floor(64 * p + 2 * deviation(p, 64))
    total = math.floor(64 * words * p + 2 * deviation(p, 64 * words))
    width, lead = 64 // blocks, near // blocks
    level = F.floor(F.log(F.greatest(F.col("n_shingles"), F.lit(1))) / -math.log(similarity)).cast("int")
    largest = nodes.groupBy(level.alias("level")).count().agg(F.max("count")).first()[0] or 1
    depth = min(width, max(0, math.ceil(math.log2(largest / cap))))
    masks = [sum(1 << i for i in bits) for n in range(min(lead, depth) + 1) for bits in combinations(range(depth), n)]
    rows = dealt(_by_block(nodes, level, blocks, depth), masks, 1, cap)
    return _joined(rows, words, blocks, Budget(width, lead), (Budget(64, near), Budget(64 * words, total)))


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """`root, node, set` of the wanted nodes (`root, name, key`): their shingle sets, from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = byte_column(batch, "t"), 0
            for a, b in slices(texts):
                sets = [u.view(np.int64) for u in shingle_sets(texts[a:b], size)]
                yield pa.RecordBatch.from_arrays([batch.column("root").slice(at, b - a), batch.column("name").slice(at, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["root", "node", "set"])
                at = b

    texts = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), F.col("text").alias("t")).dropDuplicates(["key"])
    return wanted.join(texts, "key").select("root", "name", "t").mapInArrow(tidy(run), "root string, node string, set array<long>")


def near_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = 4) -> tuple[DataFrame, DataFrame]:
    """`name, fp, n_shingles, key` of the distinct shingle sets, and `node, leader` of those in candidate groups.

    Candidates come from the trie join of fingerprints; each follower is verified by the exact
    Jaccard similarity of its shingle set with its leader's.
    """
    nodes = nodes_of(stored(set_fingerprints(docs, size, words), "dedup-fingerprints"))
    groups = components(similarity_links(nodes, similarity, words))
    wanted = groups.select(F.col("node").alias("name"), "root").join(nodes.select("name", "key"), "name")
    return nodes, led(sets_of(docs, wanted, size), similarity)


def keep_one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input rows without near copies: the first of its kind by id stays.

    A row goes if its text's shingle set equals that of a row with a smaller id, or has at least
    `similarity` with that of a row that stays and has a smaller id. All input columns are returned.
    Rows of equal ids and equal texts count as copies.
    """
    nodes, found = near_classes(docs, size, similarity)
    gone = found.where("node <> leader").select(F.col("node").alias("name"))
    stay = nodes.select("name", "key").join(gone, "name", "left_anti").select("key")
    rows = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), row_of(docs).alias("row"))
    return rows.dropDuplicates(["key"]).join(stay, "key", "left_semi").select("row.*")
