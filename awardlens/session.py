"""Session helper used by tests, the bench and the smoke entry."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A local session with the settings that the registered queries are compared under."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName("awardlens")
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
