"""Graphs that grow over the years: a spanning forest by first year, and what it says of every year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators.graph import components
from awardlens.operators.settle import settled


def _rooted(hooks: DataFrame) -> DataFrame:
    """`c, root` of hooks(c, to), a forest but for pairs that point at each other, by pointer jumping."""
    back = hooks.select(F.col("c").alias("to"), F.col("to").alias("back"))
    parent = settled(hooks.hint("merge").join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")), "forest-hooks")
    while True:
        up = parent.select(F.col("c").alias("root"), F.col("root").alias("next"))
        step = settled(parent.hint("merge").join(up, "root", "left").select("c", "root", F.coalesce("next", "root").alias("next")), "forest-jumps")
        parent = step.select("c", F.col("next").alias("root"))
        if step.where("root <> next").isEmpty():
            return parent


def spanning_forest(edges: DataFrame) -> DataFrame:
    """`src, dst, year`: a minimum spanning forest of undirected edges by year, ties by the ends' names.

    Boruvka: in every round each component takes its first edge to another one, so at least half of the
    components go. Two nodes are linked by forest edges up to a year exactly if they are by all edges
    up to it, so a forest of nodes - 1 edges stands for the whole graph at every year.
    """
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("year").alias("year"))
    left = settled(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "year", "src", "dst"), "forest-edges")
    forest = None
    while not left.isEmpty():
        edge = F.struct("year", "src", "dst")
        both = left.select(F.col("a").alias("c"), F.col("b").alias("to"), edge.alias("e")).unionByName(left.select(F.col("b").alias("c"), F.col("a").alias("to"), edge.alias("e")))
        first = settled(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("f")).select("c", "f.to", "f.e"), "forest-first")
        chosen = settled(first.select("e.src", "e.dst", "e.year").distinct(), "forest")
        forest = chosen if forest is None else forest.unionByName(chosen)
        roots = _rooted(first.select("c", "to")).hint("shuffle_hash")  # no join of nodes sends them through the driver
        moved = left.join(roots.select(F.col("c").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("c").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        kept = moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("year", "src", "dst")).alias("e"))
        left = settled(kept.select("a", "b", "e.year", "e.src", "e.dst"), "forest-edges")
    return forest if forest is not None else pairs


def reveal_years(edges: DataFrame) -> DataFrame:
    """`id, reveal`: the first year of an edge at each node."""
    ends = edges.select(F.col("src").alias("id"), "year").unionByName(edges.select(F.col("dst").alias("id"), "year"))
    return ends.groupBy("id").agg(F.min("year").alias("reveal"))


def replay(edges: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """`year, nodes, edges, giant` for every year from the first to the last: what is there by then.

    edges: src, dst (text), year; each row is an edge. The years are those of the edges and of also(year). Components of all years run as one graph over the
    forest's edges, repeated for the years that have them.
    """
    edges = settled(edges.where(F.col("year").isNotNull()).select("src", "dst", "year"), "replay-edges")
    seen = edges.select("year") if also is None else edges.select("year").unionByName(also.select("year"))
    span = seen.agg(F.min("year").alias("first"), F.max("year").alias("last")).where("first IS NOT NULL")  # one row
    years = span.select(F.explode(F.sequence("first", "last")).alias("y"))
    at = lambda c: F.concat_ws("|", F.col("y").cast("string"), F.col(c))
    grown = spanning_forest(edges).join(F.broadcast(years), F.col("year") <= F.col("y")).select(at("src").alias("src"), at("dst").alias("dst"))
    sizes = components(grown).groupBy(F.substring_index("component", "|", 1).cast("int").alias("y"), "component").agg(F.count("*").alias("n")).groupBy("y").agg(F.max("n").alias("giant"))
    upto = Window.orderBy("y")  # one row for each year
    counted = lambda rows, year, name: years.join(rows.groupBy(F.col(year).alias("y")).agg(F.count("*").alias("n")), "y", "left").select("y", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias(name))
    return counted(reveal_years(edges), "reveal", "nodes").join(counted(edges, "year", "edges"), "y").join(sizes, "y", "left").select(F.col("y").alias("year"), "nodes", "edges", F.coalesce("giant", F.when(F.col("nodes") > 0, 1).otherwise(0)).alias("giant"))
