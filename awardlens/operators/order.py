"""Places in an order over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators.settle import settled


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place in an order over all, from 1, without one task seeing all rows.

    Rows are sorted over ranges and written; ranges are counted, and a row's place is its own in its range
    after the rows of the ranges before.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    parts = settled(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    placed = parts.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.select((F.col("_before") + F.col("_at") + 1).cast("int").alias(name), *rows.columns)
