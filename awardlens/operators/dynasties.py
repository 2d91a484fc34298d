"""Families in office, their ties to firms and the value they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def families(officials: DataFrame, least: int = 2) -> DataFrame:
    """Families by surname and province: members, positions, span of terms, overlap, score and type.

    Overlapping terms are found by order of start: a term overlaps an earlier one if it starts before
    the latest end so far, so no family is joined with itself.
    """
    by = Window.partitionBy("surname", "province").orderBy("term_start", "person").rowsBetween(Window.unboundedPreceding, -1)
    rows = officials.withColumn("over", (F.col("term_start") <= F.max("term_end").over(by)).cast("int"))
    found = rows.groupBy("surname", "province").agg(
        F.count("*").alias("member_count"),
        F.array_join(F.sort_array(F.collect_set("position")), ",").alias("positions"),
        F.count_distinct("position").alias("n_positions"),
        F.min("term_start").alias("earliest_term"),
        F.max("term_end").alias("latest_term"),
        F.coalesce(F.max("over"), F.lit(0)).alias("o"),
    ).where(F.col("member_count") >= least)
    years = F.round(F.datediff("latest_term", "earliest_term") / 365.25, 4)
    score = F.round(F.least(F.lit(100.0), 10.0 * F.col("member_count") + 5.0 * F.col("n_positions") + 2.0 * F.coalesce("duration_years", F.lit(0.0))), 4)
    spanned = found.withColumn("duration_years", years)
    kind = F.when(F.col("o") == 1, "fat").otherwise("thin")
    return spanned.select("surname", "province", "member_count", "positions", "earliest_term", "latest_term", "duration_years", score.alias("dynasty_score"), kind.alias("dynasty_type"))


def captured_value(awards: DataFrame, tied: DataFrame) -> DataFrame:
    """Value of firms with and without a tie to a family, and its share."""
    marked = awards.join(tied.select("firm").distinct().withColumn("t", F.lit(True)), "firm", "left")
    sums = marked.groupBy(F.when(F.col("t"), "dynasty").otherwise("independent").alias("kind")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val"))
    total = sums.agg(F.sum("val").alias("total"))  # one row
    return sums.crossJoin(F.broadcast(total)).select("kind", "n", F.round("val", 2).alias("val"), F.round(100 * F.col("val") / F.col("total"), 4).alias("share_pct"))
