"""Graph operators over edge frames: components, ranks, paths, cycles, centrality, communities.

Edges are `src, dst` rows (with an `id` where a path must not use an edge twice). Iterative
operators write each round's small state to the shared folder and stop when nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators import between, blocks
from awardlens.operators.settle import path_exists, settled


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, distinct, without loops."""
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """`id, component`: the smallest node that each node reaches.

    Every round takes the least label among a node and its neighbours, then the label of that
    label (pointer jumping), so long chains take few rounds. Labels are joined by shuffles, so that
    none pass through the driver.
    """
    both = settled(undirected(edges), "component-edges")
    labels = settled(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "component-labels")
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("id", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.hint("merge").join(around, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("c2"))
        fresh = settled(step.join(jump.hint("merge"), "c", "left").select("id", "old", F.least("c", F.coalesce("c2", "c")).alias("component")), "component-labels")
        labels = fresh.select("id", "component")
        if fresh.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def component_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, edges and density of each component; edges are distinct unordered pairs."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    sizes = labels.groupBy("component").agg(F.count("*").alias("n_nodes"))
    counts = pairs.join(labels.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
    n = F.col("n_nodes")
    return sizes.join(counts, "component").withColumn("density", F.round(2.0 * F.col("n_edges") / (n * (n - 1)), 6))


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node."""
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank of an undirected graph over a fixed number of rounds; edges have `weight`."""
    e = edges.select("src", "dst", "weight")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("out"))
    move = settled(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "rank-shares")
    nodes = settled(out.select(F.col("src").alias("id")), "rank-nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for k in range(rounds):
        came = move.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        rank = nodes.join(came, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("came", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank = settled(rank, "ranks")
    return rank


def pagerank_converged(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100, every: int = 4, resume: str | None = None) -> DataFrame:
    """`id, rank` of directed weighted edges, until the ranks' changes sum to less than nodes * `tolerance` in a round.

    Nodes without outgoing weight share their rank among all nodes. After `every` rounds the state is
    written and the last change measured; `most` rounds without standing still are an error. With a
    folder in `resume` the written states are kept there, and a later call goes on from the last one.
    """
    spark = edges.sparkSession
    e = edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")).where("weight > 0")
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    move = settled(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "rank-shares")
    ends = move.select(F.col("src").alias("id"), F.lit(1).alias("gives")).unionByName(move.select(F.col("dst").alias("id"), F.lit(0).alias("gives")))
    nodes = settled(ends.groupBy("id").agg(F.max("gives").alias("gives")), "rank-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    rounds = range(every, most + every, every)
    done = [r for r in rounds if resume and path_exists(spark, f"{resume}/round={r}/_SUCCESS")]
    state = spark.read.parquet(f"{resume}/round={done[-1]}") if done else nodes.select("id", "gives", F.lit(1.0 / n).alias("rank"), F.lit(float("inf")).alias("before"))
    for r in rounds:
        if done and r <= done[-1]:
            continue
        for _ in range(every):
            idle = state.where("gives = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))  # one row
            came = move.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
            fresh = (1 - damping) / n + damping * (F.coalesce("came", F.lit(0.0)) + F.col("idle") / n)
            state = state.join(came, "id", "left").crossJoin(F.broadcast(idle)).select("id", "gives", fresh.alias("fresh"), F.col("rank").alias("before")).withColumnRenamed("fresh", "rank")
        if resume:
            state.write.mode("overwrite").parquet(f"{resume}/round={r}")
            state = spark.read.parquet(f"{resume}/round={r}")
        else:
            state = settled(state, "ranks")
        if state.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < n * tolerance:
            return state.select("id", "rank")
    raise RuntimeError(f"ranks still change after {most} rounds")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """`id, label` after rounds of taking the neighbours' heaviest label, ties to the smallest."""
    e = edges.select("src", "dst", "weight")
    both = settled(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "label-edges")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        labels = settled(votes.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")), "labels")
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a labelling of weighted undirected edges."""
    e = edges.select("src", "dst", "weight").join(labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    ends = e.select(F.col("ls").alias("label"), "weight").unionAll(e.select(F.col("ld").alias("label"), "weight")).groupBy("label").agg(F.sum("weight").alias("k"))
    inner = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("weight")).otherwise(0)).alias("inside"))
    return ends.crossJoin(inner).groupBy("m", "inside").agg(F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("expected")).select(F.round(F.col("inside") / F.col("m") - F.col("expected"), 6).alias("modularity"))


def betweenness(edges: DataFrame, pivots: int = 600) -> DataFrame:
    """Betweenness from the first `pivots` nodes by id, scaled as if from all; unweighted.

    All pivots walk breadth-first together, in blocks of nodes and parts of pivots (`between.py`).
    """
    return between.betweenness(settled(undirected(edges), "between-edges"), pivots)


def distances(edges: DataFrame, start, depth: int) -> DataFrame:
    """`id, dist` of all nodes within `depth` steps of a node, directions ignored."""
    both = settled(undirected(edges), "walk-edges")
    seen = both.where(F.col("src") == start).select(F.col("src").alias("id")).limit(1).withColumn("dist", F.lit(0))
    for d in range(1, depth + 1):
        front = seen.where(F.col("dist") == d - 1)
        step = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
        new = step.join(seen, "id", "left_anti").withColumn("dist", F.lit(d))
        seen = settled(seen.unionByName(new), "walk-seen")
    return seen


def shortest_path(edges: DataFrame, start, end, depth: int = 6) -> DataFrame:
    """The shortest path's nodes in order, of several the smallest; no row beyond `depth` steps.

    The frontier keeps one smallest path for each node it reaches, so it never holds more rows
    than the graph has nodes.
    """
    both = settled(undirected(edges), "path-edges")
    reached = both.where(F.col("src") == start).select(F.col("src").alias("id")).limit(1).select("id", F.array("id").alias("path"))
    seen = reached.select("id")
    for _ in range(depth):
        if not reached.where(F.col("id") == end).isEmpty():
            break
        step = reached.join(both, reached["id"] == both["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        reached = settled(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "path-front")
        seen = settled(seen.unionByName(reached.select("id")), "path-seen")
    return reached.where(F.col("id") == end).select(F.array_join("path", ",").alias("path"), (F.size("path") - 1).alias("hops"))


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Directed cycles of 2 to `longest` steps without a repeated node, from their smallest node.

    Both halves only visit nodes greater than the start, so each cycle is found once: a way out and a way back meet
    at the middle node, and no longer way than half a cycle is shuffled.
    """
    e = settled(edges.select("src", "dst").where("src <> dst").distinct(), "cycle-edges")
    ahead = {1: e.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("dst").alias("out"))}
    back = {1: e.where("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("at"), F.array().cast(ahead[1].schema["out"].dataType).alias("home"))}
    for k in range(2, (longest + 1) // 2 + 1):
        step = ahead[k - 1].join(e.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").where((F.col("next") > F.col("start")) & ~F.array_contains("out", F.col("next")))
        ahead[k] = step.select("start", F.col("next").alias("at"), F.concat("out", F.array("next")).alias("out"))
    for k in range(2, longest // 2 + 1):
        step = back[k - 1].join(e.select(F.col("dst").alias("at"), F.col("src").alias("next")), "at").where((F.col("next") > F.col("start")) & (F.col("next") != F.col("at")) & ~F.array_contains("home", F.col("next")))
        back[k] = step.select("start", F.col("next").alias("at"), F.concat(F.array("at"), "home").alias("home"))
    found = None
    for n in range(2, longest + 1):
        met = ahead[(n + 1) // 2].join(back[n // 2], ["start", "at"]).where(~F.arrays_overlap("out", "home"))
        closed = met.select(F.lit(n).alias("hops"), F.array_join(F.concat(F.array("start"), "out", "home"), ">").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
    return found


def trails(edges: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """Directed trails of 1 to `longest` edges from the nodes of `starts(id)`; no edge twice.

    edges: id, src, dst, type. Gives the nodes, the number of hops and of distinct edge types.
    """
    e = edges.select("id", "src", "dst", "type")
    now = starts.select(F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<long>").alias("used"), F.array().cast("array<string>").alias("types"))
    found = None
    for n in range(1, longest + 1):
        step = now.join(e, now["at"] == e["src"]).where(~F.array_contains("used", F.col("id")))
        now = step.select(F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("used", F.array("id")).alias("used"), F.array_union("types", F.array("type")).alias("types"))
        part = now.select(F.lit(n).alias("hops"), F.array_join("nodes", ">").alias("path"), F.array_join("used", ",").alias("edge_ids"), F.size("types").alias("n_types"))
        found = part if found is None else found.unionByName(part)
    return found


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c with all three edges, each once."""
    pairs = settled(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct(), "triangle-edges")
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    deg = settled(ends.groupBy("id").agg(F.count("*").alias("d")), "triangle-degrees")
    low, high = (deg.select(F.col("id").alias(c), F.col("d").alias(f"d{c}")) for c in "ab")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    # from the end of smaller degree: no node then has more than sqrt(2 * edges) outgoing ones, hubs least of all
    out = settled(pairs.join(low, "a").join(high, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")), "triangle-arcs")
    # two ends of a node's arcs meet in the task of their blocks, where the edge between them is looked up: no wedge is shuffled, and no row for a node and two blocks
    held = out.select(F.lit(0).alias("grp"), F.col("u").alias("item"), F.col("v").alias("member"), F.lit(1.0).alias("x"), F.lit(1.0).alias("u"))
    return blocks.closed_pairs(held, pairs.select(F.lit(0).alias("grp"), "a", "b", F.lit(0).alias("since")))


def adamic_adar(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sum over common neighbours of 1 / ln(degree) for candidate pairs (a, b)."""
    both = undirected(edges)
    deg = both.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("d"))
    left = candidates.join(both.select(F.col("src").alias("a"), F.col("dst").alias("mid")), "a")
    common = left.join(both.select(F.col("src").alias("b"), F.col("dst").alias("mid")), ["b", "mid"]).join(deg, "mid")
    return common.groupBy("a", "b").agg(F.round(F.sum(F.when(F.col("d") > 1, 1 / F.log("d")).otherwise(0.0)), 6).alias("score"), F.count("*").alias("n_common"))


def _partners(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The neighbours of each node (item) as members for `blocks`, all of weight one, and the edges as links."""
    both = settled(undirected(edges), "partner-edges")
    held = both.select(F.lit(0).alias("grp"), F.col("dst").alias("item"), F.col("src").alias("member"), F.lit(1.0).alias("x"), F.lit(1.0).alias("u"))
    return held, both.where("src < dst").select(F.lit(0).alias("grp"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("since"))


def open_adamic_adar(edges: DataFrame, digits: int = 9) -> DataFrame:
    """`a, b, score, common` of all pairs with a common neighbour and no edge: the sum of 1 / ln(degree) over common neighbours, to so many digits, and their number."""
    held, links = _partners(edges)
    deg = held.groupBy("item").agg(F.count("*").alias("d"))
    weighed = held.join(deg, "item").withColumn("u", F.when(F.col("d") > 1, 1 / F.log("d")).otherwise(F.lit(0.0)))

    def make(strips: Iterator[blocks.Strip]) -> Iterator[pd.DataFrame]:
        for s in strips:
            r, c, a, b = s.at()
            yield pd.DataFrame({"a": a, "b": b, "score": blocks.rounded(s.score[r, c], digits), "common": s.common[r, c]})

    return blocks.found_pairs(weighed, links, make, "a long, b long, score double, common long", scored=True)


def most_common_partners(edges: DataFrame, n: int) -> DataFrame:
    """`a, b, common`: the n pairs without an edge that have most common neighbours, ties by a and b. Each task keeps its n best."""
    held, links = _partners(edges)
    return blocks.best_pairs(held, links, lambda s: (s.common, None), n).select("a", "b", "common")


def ranked_neighbours(pairs: DataFrame, n: int, tasks: int | None = None) -> DataFrame:
    """The n strongest partners of each member of (a, b, w) pairs, both ways; ranked in so many tasks where given."""
    both = pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = both.repartition(tasks, "a") if tasks else both
    order = Window.partitionBy("a").orderBy(F.desc("w"), "b")
    return both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select(F.col("a").alias("firm"), F.col("b").alias("partner"), "w", "k")
