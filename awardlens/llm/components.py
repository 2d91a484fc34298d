"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.llm.text import drop_folder, shared_folder


def _with_least(edges: DataFrame, least: DataFrame, held: int) -> DataFrame:
    """`u, v` edges with `m` of `least` (`u, m, n`: n edges of u).

    Nodes of over `held` edges are hot join keys. There are at most edges / held of them, and held
    grows with the edges so that they are 100,000 at most: they are broadcast, the rest is joined.
    """
    hot = F.broadcast(least.where(F.col("n") > held).select("u", F.col("m").alias("hot_m")))
    marked = edges.join(hot, "u", "left")
    few = marked.where("hot_m IS NULL").select("u", "v").join(least.where(F.col("n") <= held).select("u", "m"), "u")
    return marked.where("hot_m IS NOT NULL").select("u", "v", F.col("hot_m").alias("m")).unionByName(few)


def components(edges: DataFrame, max_rounds: int = 60, hot_edges: int = 64) -> DataFrame:
    """`node, root` for every node of `src, dst`; root is the smallest node of its component.

    Each round moves every edge closer to the smallest neighbour; rounds end when no edge moves
    (an error after `max_rounds`, many more than the logarithm of any graph's size needs). Edges
    are written to the shared folder after each round, so a lost executor costs one round. Minima
    are taken by partial aggregation, and nodes of many edges are joined by broadcast, so the centre
    of a large star is no hot group. Null ends are ignored; self loops keep their node as a
    component of one.
    """
    spark = edges.sparkSession
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    loops = clean.where("src = dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    pairs = clean.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_folder(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = written(pairs.distinct())
    edges_now, seen = now.count(), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        held = max(hot_edges, 2 * edges_now // 100_000)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), low, held).select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = large.distinct().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = up.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(up, low2, held).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        fresh, fresh_path = written(small)
        state = fresh.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_folder(spark, path)
        now, path = fresh, fresh_path
        if (state.n, state.h) == seen:
            break
        edges_now, seen = state.n, (state.n, state.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    lone = loops.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct().join(found, "node", "left_anti")
    return found.unionByName(lone)
