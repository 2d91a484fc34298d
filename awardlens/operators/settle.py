"""Cutting the lineage of iterative jobs by tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame under the shared checkpoint folder and read it back.

    The folder is the session's spark.checkpoint.dir; where that is unset, one of our own in local
    mode alone.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file:///tmp/checkpoints/awardlens"
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, through Hadoop's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
