"""First trails and cycles in order, by half-paths and pruned beginnings in place of all trails.

A trail uses no edge twice. Trails are ordered by their nodes' names, joined by '>'; a trail's
beginning, with a '>' behind it, comes no later than the beginnings of all later trails. So whatever
is cut from a sorted list of beginnings only leads to later trails: if enough whole trails come
from those that are kept, they are the first ones, else more are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardlens.operators.settle import settled

#: Beginnings that are kept at first; four times as many where those lead to too few trails.
KEPT = 512


def _named(nodes: str) -> Column:
    return F.concat(F.array_join(nodes, ">"), F.lit(">"))


def _grown(now: DataFrame, e: DataFrame) -> DataFrame:
    """One step further: first, at, nodes, used, carried, from edges (id, src, dst, what)."""
    step = now.join(e, now["at"] == e["src"]).where(~F.array_contains("used", F.col("id")))
    return step.select("first", F.col("dst").alias("at"), F.concat("nodes", F.array(F.col("dst"))).alias("nodes"), F.concat("used", F.array("id")).alias("used"), F.concat("carried", F.array("what")).alias("carried"))


def _begun(starts: DataFrame) -> DataFrame:
    return starts.select(F.col("id").alias("first"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("carried"))


def first_cycles(edges: DataFrame, longest: int, limit: int, start=None) -> DataFrame:
    """`hops, path, amounts`: the first directed cycles of 2 to `longest` steps by length and nodes, from every node or one.

    edges: src, dst, amount, one for each pair. No edge is used twice; a cycle counts once for each of its
    nodes. A cycle of n steps is a half of n / 2 steps (rounded up) out of a node and one of the rest back into
    it. The first outward halves are kept, the inward halves are those of their nodes alone, both meet at the
    node in the middle, and their edges are compared there.
    """
    e = edges.where("src <> dst").select(F.concat_ws("~", "src", "dst").alias("id"), "src", "dst", F.col("amount").cast("decimal(18,2)").cast("string").alias("what"))
    e = settled(e, "cycle-edges")
    back = e.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "what")
    starts = settled(e.select(F.col("src").alias("id")).distinct() if start is None else e.where(F.col("src") == start).select(F.col("src").alias("id")).distinct(), "cycle-starts")
    found, missing = None, limit
    for n in range(2, longest + 1):
        kept = max(KEPT, 4 * limit)
        while True:
            out, cut = _begun(starts), False
            for _ in range(-(-n // 2)):
                out = settled(_grown(out, e).orderBy(_named("nodes")).limit(kept), "cycle-out")
                cut = cut or out.count() == kept
            home = _begun(out.select(F.col("first").alias("id")).distinct())
            for _ in range(n // 2):
                home = settled(_grown(home, back), "cycle-home")
            h = home.select("first", "at", F.col("nodes").alias("h_nodes"), F.col("used").alias("h_used"), F.col("carried").alias("h_carried"))
            met = out.join(h, ["first", "at"]).where(~F.arrays_overlap("used", "h_used"))
            rest = F.slice(F.reverse("h_nodes"), 2, F.size("h_nodes"))
            whole = met.select(F.array_join(F.concat("nodes", rest), ">").alias("path"), F.array_join(F.concat("carried", F.reverse("h_carried")), ",").alias("amounts"))
            part = settled(whole.orderBy("path").limit(missing), "cycles")
            got = part.count()
            if not cut or got == missing:
                break
            kept *= 4
        part = part.select(F.lit(n).alias("hops"), "path", "amounts")
        found, missing = part if found is None else found.unionByName(part), missing - got
        if missing <= 0:
            break
    return found


def _masks(e: DataFrame, steps: int) -> list[DataFrame]:
    """For 0 to `steps` further steps: src, masks (the sets of edge types that walks of so many steps collect)."""
    out = [settled(e.select("src").union(e.select("dst")).distinct().select("src", F.array(F.lit(0)).alias("masks")), "trail-masks")]
    for _ in range(steps):
        ahead = e.join(out[-1].select(F.col("src").alias("dst"), F.explode("masks").alias("m")), "dst")
        out.append(settled(ahead.groupBy("src").agg(F.collect_set(F.col("bit").bitwiseOR(F.col("m"))).alias("masks")), "trail-masks"))
    return out


def diverse_trails(edges: DataFrame, start, shortest: int, longest: int, least_types: int, limit: int) -> DataFrame:
    """`hops, path, n_types`: the first trails from a node, directions ignored: most edge types first, then fewest steps, then by their nodes.

    edges: id, src, dst, type (30 types at most). No trail ends where it began. For each number of types and of
    steps the first beginnings are kept that can still collect so many types: what walks of the remaining
    steps collect is known for each node as sets of types.
    """
    kinds = [r.type for r in edges.select("type").distinct().orderBy("type").limit(31).collect()]
    if len(kinds) > 30:
        raise ValueError("more than 30 edge types")
    bit = F.lit(0)
    for k, kind in enumerate(kinds):
        bit = F.when(F.col("type") == kind, F.lit(1 << k)).otherwise(bit)
    one = edges.select(F.col("id").cast("string").alias("id"), "src", "dst", bit.alias("bit"))
    e = settled(one.unionByName(one.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "bit")), "trail-edges")
    ahead, steps = _masks(e, longest - 1), e.select("id", "src", "dst", F.col("bit").cast("string").alias("what"))
    first = settled(e.where(F.col("src") == start).select(F.col("src").alias("id")).limit(1), "trail-start")
    own = F.aggregate("carried", F.lit(0), lambda a, x: a.bitwiseOR(x.cast("int")))
    found, missing = None, limit
    for types in range(len(kinds), least_types - 1, -1):
        for n in range(shortest, longest + 1):
            kept = max(KEPT, 4 * limit)
            while True:
                now, cut = _begun(first), False
                for k in range(1, n + 1):
                    can = F.exists("masks", lambda m: F.bit_count(m.bitwiseOR(own)) == types)
                    step = _grown(now, steps).join(ahead[n - k].select(F.col("src").alias("at"), "masks"), "at").where(can)
                    if k == n:
                        step = step.where(F.col("at") != F.col("first"))
                    name = F.array_join("nodes", ">") if k == n else _named("nodes")
                    now = settled(step.select("first", "at", "nodes", "used", "carried").orderBy(name, "used").limit(missing if k == n else kept), "trails")
                    cut = cut or (k < n and now.count() == kept)
                got = now.count()
                if not cut or got == missing:
                    break
                kept *= 4
            part = now.select(F.lit(n).alias("hops"), F.array_join("nodes", ">").alias("path"), F.lit(types).alias("n_types"))
            found, missing = part if found is None else found.unionByName(part), missing - got
            if missing <= 0:
                return found
    return found
