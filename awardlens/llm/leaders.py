"""Exact verification of candidate groups: one leader for each group of near copies.

Candidate groups come from fingerprints. Inside a group, nodes are taken in the order of their
names: a node whose shingle set has at least the wanted Jaccard similarity with an earlier leader
follows it, every other node is a leader itself. So each follower is verified against the leader
that stays for it, and two leaders of a group never reach the similarity.

Rounds take the first few nodes of every group at once. Those of them that match no earlier one
are leaders for certain; all nodes of the group are compared with these, and leaders and followers
leave the pool. What remains comes again with eight times as many, so groups of many copies shrink
at once and groups of unlike texts end soon. Only leaders' sets are sent more than once: large
groups are cut in pieces, each of which gets them. All pools are written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardlens.llm.text import stored

FIRST, MOST, PIECE_ROWS = 4, 1024, 256


def reaches(a: Column, b: Column, similarity: float) -> Column:
    """Whether the Jaccard similarity of two arrays of distinct values reaches `similarity`."""
    n, m, shared = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    possible = (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9)
    return F.when(possible, shared >= (n + m - shared) * similarity - 1e-9).otherwise(False)


def _pieces(pool: DataFrame, piece_rows: int) -> DataFrame:
    """`root, pieces` of the groups of over `piece_rows` nodes, 100,000 groups at most."""
    sizes = pool.groupBy("root").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    held = max(piece_rows, whole // 100_000)
    return sizes.where(F.col("n") > held).select("root", F.ceil(F.col("n") / held).cast("int").alias("pieces"))


def led(groups: DataFrame, similarity: float, first: int = FIRST, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """`node, leader` of every node of `root, node, set`; a leader is its own. Nodes are distinct strings."""
    pool, k, found = stored(groups.select("root", "node", "set"), "leader-pool"), first, None
    while pool.limit(1).count():
        hot = F.broadcast(_pieces(pool, piece_rows))
        ranked = pool.select("root", "node").withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("node"))).where(F.col("r") <= k)
        ahead = pool.join(ranked.select("node"), "node").select("root", F.col("node").alias("leader"), F.col("set").alias("led_by"))
        ahead = stored(ahead, "leaders-ahead")
        later = ahead.select("root", F.col("leader").alias("later"), F.col("led_by").alias("other"))
        doubtful = ahead.join(later, "root").where((F.col("later") > F.col("leader")) & reaches(F.col("led_by"), F.col("other"), similarity))
        certain = stored(ahead.join(doubtful.select(F.col("later").alias("leader")).distinct(), "leader", "left_anti"), "leaders")
        pieces = F.coalesce("pieces", F.lit(1))
        sent = certain.join(hot, "root", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        members = pool.join(hot, "root", "left").withColumn("piece", F.pmod(F.xxhash64("node"), pieces.cast("long")).cast("int")).drop("pieces")
        met = members.join(sent.drop("pieces"), ["root", "piece"]).where((F.col("node") > F.col("leader")) & reaches(F.col("set"), F.col("led_by"), similarity))
        done = met.groupBy("node").agg(F.min("leader").alias("leader")).unionByName(certain.select(F.col("leader").alias("node"), "leader"))
        done = stored(done, "leaders-done")
        found = done if found is None else found.unionByName(done)
        pool, k = stored(pool.join(done.select("node"), "node", "left_anti").select("root", "node", "set"), "leader-pool"), min(MOST, 8 * k)
    return found if found is not None else pool.select("node", F.col("root").alias("leader"))
