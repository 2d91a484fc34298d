"""Structured Streaming counterparts of the collector's state and the request limiter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of files not seen before; the checkpoint remembers the files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def request_counts(events: DataFrame, limit: int, length: str = "60 seconds", step: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests of each client in sliding windows, and whether they pass a limit; events: ts, client."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "client").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "client", "n", (F.col("n") > limit).alias("over"))


def yearly_totals(contracts: DataFrame, late: str = "30 days") -> DataFrame:
    """Running totals by year and office of a stream of contracts: award_ts, office, amount."""
    marked = contracts.withWatermark("award_ts", late)
    return marked.groupBy(F.year("award_ts").alias("year"), "office").agg(F.count("*").alias("n"), F.sum("amount").alias("val"))
