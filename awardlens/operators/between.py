"""Betweenness from many pivots at once: the paths into a block of nodes, from some pivots, are one matrix in one task.

Nodes are numbered and cut in blocks, pivots in parts. A node on the front sends one row with its numbers of paths to
each block where it has neighbours, and the task of that block and part adds them up; no row is made for an edge
and a pivot. Rows stream through a task, which holds one matrix. The way back is the same step with shares of paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.operators.order import numbered
from awardlens.operators.settle import settled

#: Nodes of a block at most, pivots of a part, neighbours in a row, rows written together, tasks of a step.
SIZE, WIDTH, LONG, STRIP, TASKS = 65_536, 128, 1024, 2048, 256

FRONT = "n long, part int, at array<tinyint>, x array<double>"


def _lists(edges: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """n, block, to: a node's neighbours in each block as places there, in rows of at most LONG."""
    src, dst = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in ("src", "dst"))
    ends = edges.join(src.hint("merge"), "src").join(dst.hint("merge"), "dst")
    held = ends.groupBy(F.col("n_src").alias("n"), F.floor(F.col("n_dst") / size).cast("int").alias("block")).agg(F.sort_array(F.collect_list((F.col("n_dst") % size).cast("int"))).alias("to"))
    starts = F.sequence(F.lit(0), F.floor((F.size("to") - 1) / LONG).cast("int"))
    return settled(held.select("n", "block", F.explode(F.transform(starts, lambda i: F.slice("to", i * LONG + 1, LONG))).alias("to")), "between-lists")


def _met(front: DataFrame, asked: DataFrame, lists: DataFrame, size: int, groups: int, run: Callable, schema: str) -> DataFrame:
    """`run` over the rows of each block and part: what the front sends there, then what is asked of it."""
    sent = front.hint("merge").join(lists, "n").select("block", "part", F.lit(0).alias("kind"), "n", "at", "x", "to")
    own = asked.select(F.floor(F.col("n") / size).cast("int").alias("block"), "part", F.lit(1).alias("kind"), "n", "at", "x", F.array().cast("array<int>").alias("to"))
    rows = sent.unionByName(own).repartition(min(TASKS, 2 * groups), "block", "part").sortWithinPartitions("block", "part", "kind", "n")
    return rows.mapInPandas(run, schema)


def _sums(frames: Iterator[pd.DataFrame], size: int) -> Iterator[tuple]:
    """(block, part, matrix, asked row or None) for each row asked, and with None where a block and part ends."""
    m, key = np.zeros((size, WIDTH)), None
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            if (r.block, r.part) != key:
                if key is not None:
                    yield *key, m, None
                    m[:] = 0
                key = (r.block, r.part)
            if r.kind:
                yield *key, m, r
            elif 4 * len(r.at) < WIDTH:
                m[np.ix_(r.to, r.at)] += r.x
            else:
                row = np.zeros(WIDTH)
                row[r.at] = r.x
                m[r.to] += row
    if key is not None:
        yield *key, m, None


def _ahead(size: int) -> Callable:
    """The next front: numbers of paths to nodes that are not among those asked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, part, m, seen in _sums(frames, size):
            if seen is not None:
                m[seen.n % size, seen.at] = 0
                continue
            found = np.flatnonzero(m.any(axis=1))
            for some in np.array_split(found, -(-len(found) // STRIP) or 1):
                if len(some):
                    at = [np.flatnonzero(m[i]).astype(np.int8) for i in some]
                    yield pd.DataFrame({"n": some + block * size, "part": np.int32(part), "at": at, "x": [m[i, a] for i, a in zip(some, at, strict=True)]})

    return run


def _back(size: int) -> Callable:
    """The shares of the nodes asked, which are one step nearer, and the sum of what came back to each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for _, _, m, r in _sums(frames, size):
            if r is not None:
                back = m[r.n % size, r.at] * r.x
                held.append((r.n, r.part, r.at, (1 + back) / r.x, back.sum()))
            if len(held) >= STRIP:
                yield pd.DataFrame(held, columns=["n", "part", "at", "x", "back"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=["n", "part", "at", "x", "back"])

    return run


def betweenness(edges: DataFrame, pivots: int) -> DataFrame:
    """`id, betweenness` of distinct edges in both directions, from the first `pivots` nodes by id, scaled as if from all."""
    nodes = numbered(edges.select(F.col("src").alias("id")).distinct(), [F.col("id")], "n")
    nodes = settled(nodes.select("id", (F.col("n") - 1).cast("long").alias("n")), "between-nodes")
    n = nodes.count()
    k, size = min(n, pivots), max(64, min(SIZE, -(-n // 4)))
    groups = max(1, -(-n // size) * -(-k // WIDTH))
    lists = _lists(edges, nodes, size)
    first = nodes.where(F.col("n") < k).select("n", F.floor(F.col("n") / WIDTH).cast("int").alias("part"), F.array((F.col("n") % WIDTH).cast("tinyint")).alias("at"), F.array(F.lit(1.0)).alias("x"))
    levels = [settled(first, "between-level")]
    while True:
        near = levels[-1] if len(levels) == 1 else levels[-1].unionByName(levels[-2])  # neighbours are at most a level away
        front = settled(_met(levels[-1], near, lists, size, groups, _ahead(size), FRONT), "between-level")
        if front.isEmpty():
            break
        levels.append(front)
    total = nodes.select("n", F.lit(0.0).alias("back")).limit(0)
    share = levels[-1].withColumn("x", F.transform("x", lambda p: 1 / p))
    for level in reversed(levels[1:-1]):
        share = settled(_met(share, level, lists, size, groups, _back(size), f"{FRONT}, back double"), "between-back")
        total = total.unionByName(share.select("n", "back"))
    scale = n / max(1, k) / max(1, (n - 1) * (n - 2))
    parts = total.groupBy("n").agg(F.sum("back").alias("s"))
    return nodes.join(parts.hint("merge"), "n", "left").select("id", F.round(F.coalesce("s", F.lit(0.0)) * scale, 9).alias("betweenness"))
