"""MinHash fingerprints of documents, banded near-duplicate join, and successor edits.

A fingerprint holds, for each of PERMUTATIONS universal hashes h -> (a h + b) mod 2^64, the top 32
bits of the least value over the text's shingles of SHINGLE lower-cased words. Two fingerprints'
likeness is their share of equal places, an estimate of the shingle sets' Jaccard similarity.

Defined results: a null text counts as empty; a text of fewer words is one shingle, a text
without words has none and an all-ones fingerprint; equal texts have equal fingerprints; rows
with equal ids follow each other by their texts; null ids come first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardlens.llm.components import components
from awardlens.llm.leaders import led
from awardlens.llm.text import byte_column, shingles, slices, stored, tidy

PERMUTATIONS, SHINGLE = 64, 5
_R = np.random.default_rng(77)
_A = _R.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)


#: Shingles whose permuted values a worker holds at a time.
HELD = 1 << 18


def signatures(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """(texts, PERMUTATIONS) 32-bit minima; all ones for a text without words."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, dtype=np.uint32)
    for a, b in slices(texts, 1 << 20):
        h, count = shingles(texts[a:b], size)
        owner = np.repeat(np.arange(a, b), count)
        for at in range(0, len(h), HELD):
            part, own = h[at : at + HELD], owner[at : at + HELD]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows = own[starts]
            for k in range(PERMUTATIONS):
                value = ((part * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)
                out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(value, starts))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (x == y).mean(1)


def fingerprints(docs: DataFrame, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """`doc_id, fingerprint` (hex) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(byte_column(batch, "t"), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.astype(">u4").tobytes().hex() for s in sig], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidy(run), "doc_id long, fingerprint string")


# ------------------------------------------------------------------ each document with the next one


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def range_of(key: Column, cuts: list[int], first: int = 0) -> Column:
    """`first` plus the number of sorted cuts up to the key: a balanced tree, so its depth is their logarithm."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key < cuts[mid], range_of(key, cuts[:mid], first)).otherwise(range_of(key, cuts[mid + 1 :], first + mid + 1))


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """`part, look, doc_id, t` where each part also holds the row that follows its last one.

    Ids are cut in ranges of like counts. One shuffle brings each range together; the first row
    after a range is sent to it a second time with look = 1, so no range needs its neighbour. Range
    bounds come from a summary of the ids alone, and there is one bound for each partition.
    """
    spark = docs.sparkSession
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"))
    cuts = sorted({int(v) for v in (ids.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])}) if parts > 1 else []
    part = range_of(F.col("k"), cuts)
    firsts = ids.groupBy(part.alias("p")).agg(F.min("k").alias("k")).collect()  # one row per part
    order = sorted((r.p, r.k) for r in firsts)
    before = {k: order[i - 1][0] for i, (_, k) in enumerate(order)}  # the first id of a part follows the part before; the first of all closes the ring
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("part", part)
    if not before:
        return rows.select("part", F.lit(0).alias("look"), "doc_id", "t")
    ring = F.create_map(*(F.lit(v) for kv in before.items() for v in kv))
    targets = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("look")))
    wrap = F.array(F.struct(ring[F.col("k")].alias("part"), F.when(F.col("k") == order[0][1], 2).otherwise(1).alias("look")))
    both = rows.withColumn("to", F.explode(F.when(F.col("k").isin(list(before)), F.concat(targets, wrap)).otherwise(targets)))
    return both.select("to.part", "to.look", "doc_id", "k", "t").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "look", "k", "t").select("part", "look", "doc_id", "t")


def successor_report(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For every row: its fingerprint, its edited text's, and their likeness; likeness to the next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row so far: part, id, text, signature

        def report(rows: list[tuple]) -> pa.RecordBatch:
            """rows: id, text, signature, next text, next signature."""
            texts = [edited(t.decode(), n.decode()).encode() for _, t, _, n, _ in rows]
            sig, after, new = np.array([r[2] for r in rows]), np.array([r[4] for r in rows]), signatures(texts, size)
            to_hex = lambda s: [x.astype(">u4").tobytes().hex() for x in s]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1].decode()) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array(to_hex(sig), pa.string()),
                pa.array(to_hex(new), pa.string()),
                pa.array(likeness(sig, new)),
                pa.array(likeness(sig, after)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            texts = byte_column(batch, "t")
            part, look, ids = (batch.column(c).to_pylist() for c in ("part", "look", "doc_id"))
            for a, b in slices(texts, 4 << 20):
                sig, rows = signatures(texts[a:b], size), []
                for i in range(a, b):
                    if waiting is not None and waiting[0] == part[i]:
                        rows.append((*waiting[1:], texts[i], sig[i - a]))
                    waiting = (part[i], ids[i], texts[i], sig[i - a]) if look[i] == 0 else None
                if rows:
                    yield report(rows)

    return with_next(docs).mapInArrow(tidy(run), schema)


# ------------------------------------------------------------------ near duplicates


def banded(docs: DataFrame, bands: int = 16, size: int = SHINGLE) -> DataFrame:
    """`src, dst` links of candidates: each row's key with the least key that shares a band.

    One link for each row and band, so a band of very many rows is one partial minimum, not pairs.
    """
    width = PERMUTATIONS // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(byte_column(batch, "t"), size)
            keys = [[f"{k:02x}" + s[k * width : (k + 1) * width].tobytes().hex() for k in range(bands)] for s in sig]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.string()))], names=["node", "bands"])

    marked = docs.select("node", "t").mapInArrow(tidy(run), "node string, bands array<string>").select("node", F.explode("bands").alias("band"))
    marked = stored(marked, "minhash-bands")
    least = marked.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    few = F.broadcast(least.where(F.col("n") > (held := max(64, marked.count() // 100_000))).select("band", F.col("least").alias("hot")))  # at most 100,000 bands
    split = marked.join(few, "band", "left")
    rest = split.where("hot IS NULL").join(least.where(F.col("n") <= held), "band").select("node", "least")
    both = split.where("hot IS NOT NULL").select("node", F.col("hot").alias("least")).unionByName(rest)
    return both.where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 16, size: int = SHINGLE) -> DataFrame:
    """`doc_id, class_id` for every row: the smallest id of the document that stays for its kind.

    Rows that share a band of the signature are candidates; in their groups every row is compared
    exactly, by the Jaccard similarity of shingle sets, with the leaders before it (see leaders.py): a row
    follows the leader that it reaches `similarity` with, or is a leader. Equal texts are one node.
    A null id comes last, and is the class only where no row of the class has an id.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")).withColumn("hash", F.sha2("t", 256))
    first = keyed.groupBy("hash").agg(F.min("doc_id").alias("low"), F.min("t").alias("t"))
    shifted = (F.col("low").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)")
    nodes = stored(first.select(F.concat(F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit("~" * 20)), "hash").alias("node"), "hash", "low", "t"), "minhash-nodes")
    groups = components(banded(nodes, bands, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch, "t")
            for a, b in slices(texts):
                h, count = shingles(texts[a:b], size)
                end = np.cumsum(count)
                sets = [np.unique(h[e - c : e]).view(np.int64) for e, c in zip(end, count, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("root").slice(a, b - a), batch.column("node").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["root", "node", "set"])

    sets = nodes.select("node", "t").join(groups, "node").select("root", "node", "t").mapInArrow(tidy(run), "root string, node string, set array<long>")
    found = led(sets, similarity)
    lows = nodes.select("node", "hash", "low").join(found, "node", "left")
    lead = nodes.select(F.col("node").alias("leader"), F.col("low").alias("lead_low"))
    table = lows.join(lead, "leader", "left").select("hash", F.when(F.col("leader").isNull(), F.col("low")).otherwise(F.col("lead_low")).alias("class_id"))
    return keyed.select("doc_id", "hash").join(table, "hash").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
