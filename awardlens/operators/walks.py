"""Weighted random walks by alias tables that are cut in blocks, so that no node's neighbours lie in one row.

A node's neighbours are dealt over blocks of about BLOCK by a hash. A block is an alias table: an entry
is drawn by one number for its place and one for itself or its alias, whatever the weights. The blocks of
a node, weighed by their sums, are entries of a table above, and so on until each node has one table.
A step draws from the top table down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.operators.settle import settled

#: Entries of a table, about.
BLOCK = 1024

TABLE = "src long, block long, weight double, items array<long>, keep array<double>, other array<long>"


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the chance to keep it, and the place taken instead."""
    n = len(weights)
    share = weights * (n / weights.sum())
    keep, other = np.ones(n), np.arange(n)
    small, large = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while small and large:
        s, g = small.pop(), large[-1]
        keep[s], other[s] = share[s], g
        share[g] -= 1 - share[s]
        if share[g] < 1:
            small.append(large.pop())
    return keep, other


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for src, block, entries in zip(pdf["src"], pdf["block"], pdf["entries"], strict=True):
            items = np.array([e["item"] for e in entries], dtype=np.int64)
            weights = np.array([e["weight"] for e in entries])
            keep, other = alias_table(weights)
            rows.append((src, block, float(weights.sum()), items.tolist(), keep.tolist(), items[other].tolist()))
        yield pd.DataFrame(rows, columns=["src", "block", "weight", "items", "keep", "other"])


def block_tables(edges: DataFrame) -> list[DataFrame]:
    """Tables (TABLE) from the neighbours up to one table for each node; edges: src, dst, weight, taken in both directions."""
    e = edges.select("src", "dst", "weight").where("weight > 0")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    entries, levels = settled(both.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("item"), F.col("weight").cast("double").alias("weight")), "walk-entries"), []
    while True:
        parts = entries.groupBy("src").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        dealt = entries.join(parts, "src").withColumn("block", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.col("parts")))
        held = dealt.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("item", "weight"))).alias("entries"))
        levels.append(settled(held.mapInPandas(_tables, TABLE), "walk-tables"))
        if parts.where("parts > 1").isEmpty():
            return levels
        entries = levels[-1].select("src", F.col("block").alias("item"), "weight")


def _drawn(walks: DataFrame, table: DataFrame, on: list[str], step: int, level: int) -> DataFrame:
    """Walkers with `drawn`: an item of the table that they are at."""
    part = lambda salt: F.pmod(F.xxhash64("walker", F.lit(step), F.lit(level), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    joined = walks.join(table.drop("weight"), on)
    place = F.least(F.floor(part(1) * F.size("items")).cast("int"), F.size("items") - 1)
    return joined.select("walker", "walk", "src", F.when(part(2) < F.get("keep", place), F.get("items", place)).otherwise(F.get("other", place)).alias("block"))


def random_walks(edges: DataFrame, length: int = 30, per_node: int = 10, seed: int = 42) -> DataFrame:
    """`walker, walk` (node names): weighted walks of `length` nodes from every node of an undirected graph.

    All walkers take a step together; draws are hashes of walker and step, so a walk is the same wherever it runs.
    """
    levels = block_tables(edges)
    nodes = levels[-1].select("src")
    walks = nodes.select("src", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("n")).select("src", F.xxhash64(F.lit(seed), "src", "n").alias("walker"), F.array(F.col("src").cast("string")).alias("walk"))
    for step in range(1, length):
        at = _drawn(walks, levels[-1].drop("block"), ["src"], step, len(levels))
        for k in range(len(levels) - 2, -1, -1):
            at = _drawn(at, levels[k], ["src", "block"], step, k)
        walks = at.select(F.col("block").alias("src"), "walker", F.concat("walk", F.array(F.col("block").cast("string"))).alias("walk"))
        if step % 6 == 0:
            walks = settled(walks, "walks")
    return walks.select("walker", "walk")
