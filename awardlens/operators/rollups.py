"""Rollups of awards by firm, office, pair and year, and market concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def when_focus(value: Column, focus: str) -> Column:
    return F.when(F.col("category") == focus, value)


def money(c: Column) -> Column:
    """A decimal sum as a double, zero for none."""
    return F.coalesce(c, F.lit(0)).cast("double")


def firm_rollup(awards: DataFrame, focus: str) -> DataFrame:
    """Counts, values, first focus year and distinct regions, years and offices of each firm."""
    return awards.groupBy("firm").agg(
        F.count("*").alias("n_all"),
        money(F.sum("amount")).alias("val_all"),
        F.count(when_focus(F.lit(1), focus)).alias("n_focus"),
        money(F.sum(when_focus(F.col("amount"), focus))).alias("val_focus"),
        F.min(when_focus(F.col("year"), focus)).alias("first_focus_year"),
        F.count_distinct("region").alias("n_regions"),
        F.count_distinct("year").alias("n_years"),
        F.count_distinct("office").alias("n_offices"),
    )


def top_category(awards: DataFrame) -> DataFrame:
    """Each firm's most frequent category; of equals the one seen on the earliest contract."""
    counted = awards.groupBy("firm", "category").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"))
    order = Window.partitionBy("firm").orderBy(F.desc("n"), "first_ref", "category")
    return counted.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("firm", F.col("category").alias("top_category"), F.col("n").alias("n_top"))


def office_rollup(awards: DataFrame, focus: str) -> DataFrame:
    """Contracts with a firm, by office; the region is that of the latest contract."""
    contracts = awards.select("ref", "office", "region", "category", "amount", "year").distinct()
    return contracts.groupBy("office").agg(
        F.count("*").alias("n_all"),
        money(F.sum("amount")).alias("val_all"),
        F.count(when_focus(F.lit(1), focus)).alias("n_focus"),
        money(F.sum(when_focus(F.col("amount"), focus))).alias("val_focus"),
        F.min(when_focus(F.col("year"), focus)).alias("first_focus_year"),
        F.max_by("region", "ref").alias("region"),
    )


def firm_office(awards: DataFrame) -> DataFrame:
    """Awards, value and years of each firm at each office."""
    return awards.groupBy("firm", "office").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("val"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def co_pairs(rows: DataFrame, key: str = "ref", member: str = "firm", carry: tuple[str, ...] = ()) -> DataFrame:
    """All unordered pairs of members that share a key, smaller member first, with carried columns."""
    left = rows.select(key, F.col(member).alias("a"), *carry)
    right = rows.select(key, F.col(member).alias("b"))
    return left.join(right, key).where("a < b")


def co_award_pairs(awards: DataFrame, focus: str) -> DataFrame:
    """Joint contracts of each pair of firms, with value and first focus year."""
    return (
        co_pairs(awards, carry=("amount", "category", "year"))
        .groupBy("a", "b")
        .agg(
            F.count("*").alias("n"),
            money(F.sum("amount")).alias("val"),
            F.count(when_focus(F.lit(1), focus)).alias("n_focus"),
            F.min(when_focus(F.col("year"), focus)).alias("first_focus_year"),
        )
    )


def hhi(rows: DataFrame, group: list[str], firm: str = "firm", value: str = "amount", scale: float = 100.0) -> DataFrame:
    """Herfindahl index of each group over its firms' shares of value, 0 where there is no value.

    One aggregation by group and firm, then one by group: the group's total is carried along as
    the sum of the firms' sums, so no window over a group's rows is needed.
    """
    sums = rows.groupBy(*group, firm).agg(F.sum(value).cast("double").alias("v"))
    total, squares = F.sum("v"), F.sum(F.col("v") * F.col("v"))
    index = F.when(total > 0, scale * scale * squares / (total * total)).otherwise(0.0)
    return sums.groupBy(*group).agg(F.round(index, 4).alias("hhi"), F.count("*").alias("n_firms"), F.round(total, 2).alias("val"))


def concentration_level(index: Column) -> Column:
    """The level name of an index on the scale of 10,000."""
    return F.when(index >= 2500, "HIGH").when(index >= 1500, "MODERATE").otherwise("LOW")


def top_shares(rows: DataFrame, group: str, n: int, firm: str = "firm", value: str = "amount") -> DataFrame:
    """The n largest firms of each group with their share of the group's value."""
    sums = rows.groupBy(group, firm).agg(F.sum(value).cast("double").alias("v"), F.count("*").alias("n_awards"))
    totals = sums.groupBy(group).agg(F.sum("v").alias("total"))
    order = Window.partitionBy(group).orderBy(F.desc("v"), firm)
    ranked = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).join(totals, group)
    return ranked.select(group, firm, "rank", "n_awards", F.round("v", 2).alias("val"), F.round(F.when(F.col("total") > 0, F.col("v") / F.col("total")).otherwise(0.0), 6).alias("share"))


def region_share(rows: DataFrame) -> DataFrame:
    """Value and share by region of a total that includes rows without a region."""
    sums = rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("v"))
    total = sums.agg(F.sum("v").alias("total"))  # one row
    shared = sums.where("region IS NOT NULL").crossJoin(F.broadcast(total))
    return shared.select("region", "n", F.round("v", 2).alias("val"), F.round(100 * F.col("v") / F.col("total"), 4).alias("share_pct"))
