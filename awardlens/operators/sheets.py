"""All red flags from two written tables: one row for each contract, then one for each firm at each office.

The first pass brings a contract's lines together, with the contract's own columns: lone bidders, like bids,
pairs of bidders and subcontract edges are read off such a row. The second pass sorts a firm's awards at an
office once: counts near a threshold, near each other in time, away from home, and sums come from the same
rows. What is left to group are firms and offices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators.flags import flagged
from awardlens.operators.settle import settled


def bid_sheets(lines: DataFrame, contracts: DataFrame, tasks: int) -> DataFrame:
    """ref, bids (firm, least bid; by firm), best and worst (bid, firm), and the contract's columns, null where it is unknown. lines: ref, firm, bid."""
    least = lines.repartition(tasks, "ref").groupBy("ref", "firm").agg(F.min("bid").alias("bid"))
    order = F.struct("bid", "firm")
    own = least.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("firm", "bid"))).alias("bids"), F.min(order).alias("best"), F.max(order).alias("worst"))
    return settled(own.join(contracts, "ref", "left"), "bid-sheets")


def pairs(sheets: DataFrame) -> DataFrame:
    """ref, winner, a, b, bid_a, bid_b: two bidders of a contract, the smaller first."""
    rest = lambda i: F.slice("bids", i + 2, F.size("bids"))
    two = F.flatten(F.transform("bids", lambda x, i: F.transform(rest(i), lambda y: F.struct(x["firm"].alias("a"), y["firm"].alias("b"), x["bid"].alias("bid_a"), y["bid"].alias("bid_b")))))
    return sheets.where(F.size("bids") > 1).select("ref", F.col("best.firm").alias("winner"), F.explode(two).alias("p")).select("ref", "winner", "p.*")


def bid_flags(sheets: DataFrame, tasks: int, tolerance: float = 0.001, least: int = 3) -> DataFrame:
    """Flags of lone bidders, like bids and rotating winners."""
    alone = sheets.where((F.size("bids") == 1) & F.col("amount").isNotNull()).groupBy(F.col("best.firm").alias("firm")).agg(F.count("*").alias("n"), F.sum("amount").alias("v")).where(F.col("n") >= least)
    two = pairs(sheets)
    close = F.abs(F.col("bid_a") - F.col("bid_b")).cast("double") < F.col("bid_a").cast("double") * tolerance
    like = two.where((F.col("bid_a") > 0) & (F.col("bid_b") > 0) & close)
    wins = two.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("k"), F.count(F.when(F.col("winner") == F.col("a"), 1)).alias("wins_a"), F.count(F.when(F.col("winner") == F.col("b"), 1)).alias("wins_b"))
    rotating = wins.where((F.col("k") >= least) & (F.col("wins_a") > 0) & (F.col("wins_b") > 0))
    return (
        flagged(alone, "single_bidder", "medium", "firm", F.col("firm"), F.col("n"), F.col("v"))
        .unionByName(flagged(like, "identical_bids", "high", "firm", F.col("a"), F.col("b"), F.col("bid_a")))
        .unionByName(flagged(rotating, "rotating_winners", "high", "firm", F.col("a"), F.col("k"), F.col("wins_a") + F.col("wins_b")))
    )


def subcontract_edges(sheets: DataFrame, category: str) -> DataFrame:
    """src, dst, amount, n: from the firm of the largest bid to that of the smallest one of a category's contracts."""
    ends = sheets.where(F.col("category") == category).select(F.col("worst.firm").alias("src"), F.col("best.firm").alias("dst"), F.col("best.bid").alias("amount"))
    return ends.where("src <> dst").groupBy("src", "dst").agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n"))


def holdings(sheets: DataFrame, firms: DataFrame, threshold: float, focus: str, days: int = 2) -> DataFrame:
    """office, firm with counts and values: all, under the threshold, near another award in time, away from home, in focus."""
    awards = sheets.where("office IS NOT NULL").select("ref", "office", "region", "category", "amount", "award_date", F.explode("bids.firm").alias("firm"))
    order = Window.partitionBy("office", "firm").orderBy("award_date", "ref")
    before = F.datediff("award_date", F.lag("award_date").over(order)) <= days
    after = F.datediff(F.lead("award_date").over(order), "award_date") <= days
    marked = awards.withColumn("near", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    under = (F.col("amount") > 0.7 * threshold) & (F.col("amount") < threshold)
    part = lambda c, name: [F.count(F.when(c, 1)).alias(f"n_{name}"), F.sum(F.when(c, F.col("amount"))).alias(f"v_{name}")]
    found = marked.groupBy("office", "firm").agg(F.first("region").alias("region"), F.count("*").alias("n"), F.sum("amount").alias("v"), *part(under, "under"), *part(F.col("near"), "near"), *part(F.col("category") == focus, "focus"))
    return settled(found.join(firms.select("firm", "home_region", "capital"), "firm", "left"), "holdings")


def award_flags(held: DataFrame, hhi_limit: float, least: int = 3, ratio: float = 100) -> DataFrame:
    """Flags of split contracts, concentrated offices, awards away from home, small capital and awards near in time."""
    split = flagged(held.where(F.col("n_under") >= least), "split_contracts", "high", "firm", F.col("firm"), F.col("n_under"), F.col("v_under"))
    timing = flagged(held.where(F.col("n_near") >= least), "timing_cluster", "high", "firm", F.col("firm"), F.col("n_near"), F.col("v_near"))
    in_focus = held.where("n_focus > 0").select("office", F.col("v_focus").cast("double").alias("v"))
    total, squares = F.sum("v"), F.sum(F.col("v") * F.col("v"))
    index = in_focus.groupBy("office").agg(F.round(F.when(total > 0, 10000.0 * squares / (total * total)).otherwise(0.0), 4).alias("hhi"), F.count("*").alias("n_firms"), F.round(total, 2).alias("val"))
    held_by = flagged(index.where(F.col("hhi") > hhi_limit), "concentration", "high", "office", F.col("office"), F.col("n_firms"), F.col("val"))
    away = held.where("region <> home_region").groupBy("firm").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where(F.col("n") >= least)
    far = flagged(away, "geographic_anomaly", "medium", "firm", F.col("firm"), F.col("n"), F.col("v"))
    sums = held.where("capital > 0").groupBy("firm", "capital").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where(F.col("v").cast("double") / F.col("capital").cast("double") > ratio)
    shell = flagged(sums, "shell_company", "high", "firm", F.col("firm"), F.col("n"), F.col("v"))
    return split.unionByName(timing).unionByName(held_by).unionByName(far).unionByName(shell)
