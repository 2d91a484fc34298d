"""Band joins: rows of a key that lie near each other in time and amount, met by buckets in place of a self-join of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DAY = F.unix_date


def near_pairs(rows: DataFrame, by: list[str], days: int) -> DataFrame:
    """Pairs ref_a < ref_b of equal `by` columns at most `days` days apart: by..., ref_a, ref_b, date_a, date_b, amount_a, amount_b.

    rows: by..., ref, award_date, amount. A row stands in the bucket of its days and asks that one and both
    neighbours, so a pair meets exactly once, in the second row's bucket; no key holds more than a bucket's rows.
    Rows without a date have no bucket and are in no pair.
    """
    bucket = F.floor(_DAY("award_date") / days)
    side = lambda c: [F.col("ref").alias(f"ref_{c}"), F.col("award_date").alias(f"date_{c}"), F.col("amount").alias(f"amount_{c}")]
    asks = rows.select(*by, *side("a"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    stands = rows.select(*by, *side("b"), bucket.alias("bucket"))
    pairs = asks.join(stands, [*by, "bucket"]).where((F.col("ref_a") < F.col("ref_b")) & (F.abs(F.datediff("date_a", "date_b")) <= days))
    return pairs.drop("bucket")


def clusters_after(rows: DataFrame, by: list[str], days: int, ratio: int = 2) -> DataFrame:
    """For each row the rows of its key from it on, at most `days` later and of 1 / ratio to ratio times its amount: by..., anchor, n, val.

    Buckets are of days and of powers of `ratio`: an anchor asks two of the one and three of the other. Rows
    of one day count from the anchor's reference on. Amounts are over zero; rows without a date are in no cluster.
    """
    day, size = F.floor(_DAY("award_date") / days), F.floor(F.log(F.col("amount").cast("double")) / F.log(F.lit(float(ratio))))
    asks = rows.select(*by, F.col("ref").alias("anchor"), F.col("award_date").alias("d0"), F.col("amount").alias("a0"), F.explode(F.sequence(day, day + 1)).alias("day"), F.sequence(size - 1, size + 1).alias("sizes")).withColumn("size", F.explode("sizes")).drop("sizes")
    stands = rows.select(*by, "ref", "award_date", "amount", day.alias("day"), size.alias("size"))
    later = (F.col("award_date") > F.col("d0")) | ((F.col("award_date") == F.col("d0")) & (F.col("ref") >= F.col("anchor")))
    fits = later & (F.datediff("award_date", "d0") <= days) & (F.col("amount") * ratio >= F.col("a0")) & (F.col("amount") <= F.col("a0") * ratio)
    return asks.join(stands, [*by, "day", "size"]).where(fits).groupBy(*by, "anchor").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val"))
