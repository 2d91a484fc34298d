"""Longest chains: the first trails of most steps from a set of nodes, without expanding all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.operators.settle import settled

#: Partial chains that are carried at first; four times as many where those lead nowhere.
CARRIED = 256


def reach_ahead(edges: DataFrame, steps: int) -> DataFrame:
    """`id, src, dst, type, ahead` in both directions: how many steps can follow, up to `steps`, without turning back at once.

    Dynamic programming over edges and steps. A node counts its outgoing edges by what can follow them,
    so an edge learns from `steps + 1` numbers of the node it leads to, less its own way back, however
    many neighbours that node has.
    """
    e = edges.select("id", "src", "dst", "type", F.lit(0).alias("there"), F.lit(0).alias("back")).where("src <> dst")
    e = settled(e, "chain-edges")
    for n in range(1, steps + 1):
        out = e.select(F.col("src").alias("node"), F.col("there").alias("ahead")).unionByName(e.select(F.col("dst").alias("node"), F.col("back").alias("ahead")))
        counts = out.groupBy("node").agg(*(F.count(F.when(F.col("ahead") >= t, 1)).alias(f"n{t}") for t in range(n)))

        def following(own: str) -> F.Column:
            """Steps after an edge whose way back has `own` ahead, from the counts of the node it leads to."""
            best = F.lit(0)
            for t in range(n):
                best = F.when(F.col(f"n{t}") - F.when(F.col(own) >= t, 1).otherwise(0) >= 1, t + 1).otherwise(best)
            return best

        there = e.join(counts.withColumnRenamed("node", "dst"), "dst").select("id", "src", "dst", "type", "there", "back", following("back").alias("next_there"))
        e = settled(there.join(counts.withColumnRenamed("node", "src"), "src").select("id", "src", "dst", "type", F.col("next_there").alias("there"), following("there").alias("back")), "chain-edges")
    return e.select("id", "src", "dst", "type", F.col("there").alias("ahead")).unionByName(e.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.col("back").alias("ahead")))


def longest_chains(edges: DataFrame, starts: DataFrame, longest: int = 6, limit: int = 10) -> DataFrame:
    """`start, hops, chain, edge_types`: the first `limit` trails from starts(id), most steps first.

    edges: id, src, dst, type (text), taken in both directions. No edge is used twice and no trail ends
    where it began; of equal length the smallest sequence of nodes and edges comes first.

    A trail's beginnings are ordered as the trail is. So of all beginnings of each length only the first
    few are carried, and only those that can still grow long enough: whatever is dropped comes after all
    that is kept. If too few of those become whole trails, more are carried.
    """
    arcs = reach_ahead(edges, longest - 1)
    ended = arcs.sparkSession.createDataFrame([], "start string, hops int, chain string, edge_types string")
    missing = limit
    for hops in range(longest, 0, -1):
        carried = max(CARRIED, 4 * limit)
        while True:
            now = starts.select(F.col("id").alias("at"), F.array(F.struct(F.col("id").alias("node"), F.lit("").alias("edge"))).alias("steps"), F.array().cast("array<string>").alias("types"))
            cut = False
            for n in range(1, hops + 1):
                new = F.struct(F.col("dst").alias("node"), F.col("id").alias("edge"))
                used = F.exists("steps", lambda s: s["edge"] == F.col("id"))
                step = now.join(arcs.where(F.col("ahead") >= hops - n), F.col("at") == F.col("src")).where(~used)
                if n == hops:
                    step = step.where(F.col("dst") != F.get("steps", F.lit(0))["node"])
                grown = step.select(F.col("dst").alias("at"), F.concat("steps", F.array(new)).alias("steps"), F.concat("types", F.array("type")).alias("types"))
                now = settled(grown.orderBy("steps").limit(missing if n == hops else carried), "chains")
                cut = cut or (n < hops and now.count() == carried)
            if not cut or now.count() == missing:
                break
            carried *= 4
        found = now.select(F.get("steps", F.lit(0))["node"].alias("start"), F.lit(hops).alias("hops"), F.array_join(F.transform("steps", lambda s: s["node"]), ">").alias("chain"), F.array_join("types", ">").alias("edge_types"))
        ended, missing = ended.unionByName(found), missing - now.count()
        if missing <= 0:
            break
    return ended
