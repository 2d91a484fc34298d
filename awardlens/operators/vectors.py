"""Nearest vectors by an inverted file: rows lie in the cell of their nearest centre, a question reads the cells next to it.

Centres come from a bounded sample of rows (SAMPLE of them, by a hash of their ids); every row is
assigned to a cell. Cells are written in blocks of at most BLOCK rows, so a large cell is many rows of
the index and no task holds more than a few blocks. Similarities inside the cells that are read are
exact; what is approximate is only which cells are read. `measured_recall` compares with the exact way,
and `probes_for` takes the fewest cells that reach a recall on a sample of the questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators.settle import settled

#: Rows that centres are learned from, rows of a block, cells at most, and questions of a cell that meet a block together, about.
SAMPLE, BLOCK, CELLS, GROUP = 50_000, 2048, 4096, 256


@dataclass(frozen=True)
class Cells:
    """Written blocks (cell, ids, unit vectors as bytes) and the centres."""

    blocks: DataFrame
    centres: np.ndarray
    rows: int


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _matrix(column) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float64))


def build(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> Cells:
    """Cells of vectors(id, embedding); about the square root of their number where it is not given. Null vectors are left out."""
    rows = vectors.where("embedding IS NOT NULL").select("id", "embedding")
    n = rows.count()
    if not n:
        return Cells(rows.select(F.lit(0).alias("cell"), F.array("id").alias("ids"), F.lit(b"").alias("data")).limit(0), np.zeros((0, 0)), 0)
    cells = max(1, min(CELLS, cells or int(n**0.5)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE)
    points = settled(picked.select(F.transform("embedding", lambda x: x / F.greatest(norm, F.lit(1e-30))).alias("v")), "cell-sample").select(array_to_vector("v").alias("features"))
    centres = _unit(np.array(KMeans(k=cells, seed=seed, maxIter=12, initSteps=2).fit(points).clusterCenters()))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = _matrix(pdf["embedding"])
            yield pd.DataFrame({"id": pdf["id"], "cell": (m @ shared.value.T).argmax(1).astype(np.int32), "v": [x.tobytes() for x in m.astype(np.float32)]})

    placed = settled(rows.mapInPandas(assign, "id long, cell int, v binary"), "cell-rows")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = placed.hint("merge").join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "ids": [pdf["id"].tolist()], "data": [b"".join(pdf["v"])]})

    # dealt by both, so that a large cell is packed by many tasks
    blocks = dealt.repartition("cell", "part").groupBy("cell", "part").applyInPandas(pack, "cell int, ids array<long>, data binary")
    return Cells(settled(blocks.repartitionByRange("cell").sortWithinPartitions("cell"), "cell-blocks"), centres, n)


def nearest(index: Cells, questions: DataFrame, k: int, probes: int) -> DataFrame:
    """`query, id, similarity, k`: the k nearest rows of each of questions(id, embedding) in its `probes` nearest cells, itself not among them."""
    spark, centres = questions.sparkSession, index.centres
    if not index.rows:
        return spark.createDataFrame([], "query long, id long, similarity double, k int")
    shared = spark.sparkContext.broadcast(centres)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = _matrix(pdf["embedding"])
            near = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes]
            whole = [x.tobytes() for x in m.astype(np.float32) for _ in range(near.shape[1])]  # as objects: numpy's own bytes lose zeros at their end
            yield pd.DataFrame({"query": np.repeat(pdf["id"].to_numpy(), near.shape[1]), "cell": near.ravel().astype(np.int32), "q": whole})

    rows = questions.where("embedding IS NOT NULL").select("id", "embedding")
    groups = max(1, rows.count() * probes // (len(centres) * GROUP))
    asked = rows.mapInPandas(route, "query long, cell int, q binary")
    # questions of a cell meet its blocks in groups, so a block is sent once for each of them
    grouped = asked.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")).groupBy("cell", "g").agg(F.collect_list(F.struct("query", "q")).alias("asked"))
    # blocks are as large as the vectors: they meet the questions by a shuffle, not through the driver
    pairs = grouped.join(index.blocks.hint("merge"), "cell").select("asked", "ids", "data")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for asked, ids, data in zip(pdf["asked"], pdf["ids"], pdf["data"], strict=True):
                own, m = np.asarray(ids), np.frombuffer(data, dtype=np.float32).reshape(len(ids), -1)
                for one in asked:
                    s = np.round((m @ np.frombuffer(one["q"], dtype=np.float32)).astype(np.float64), 5)
                    keep = np.lexsort((own, -s))[: k + 1]
                    keep = keep[own[keep] != one["query"]][:k]
                    yield pd.DataFrame({"query": one["query"], "id": own[keep], "similarity": s[keep]})

    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    found = pairs.mapInPandas(compare, "query long, id long, similarity double")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def measured_recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query, id) that were found."""
    hits = exact.select("query", "id").join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    row = hits.agg(F.count("hit").alias("hit"), F.count("*").alias("n")).first()
    return row.hit / row.n if row.n else 1.0


def probes_for(index: Cells, questions: DataFrame, exact: DataFrame, k: int, least: float = 0.95) -> int:
    """The fewest cells, doubling from one, that give the sample's exact neighbours a recall of `least`; all cells always do."""
    probes = 1
    while probes < len(index.centres) and measured_recall(nearest(index, questions, k, probes), exact) < least:
        probes = min(2 * probes, len(index.centres))
    return probes
