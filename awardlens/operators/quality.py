"""Data-quality checks: completeness, integrity, duplicates, outliers, and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def completeness(frames: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows, missing values (null or blank) and PASS or FAIL of each required field; one pass a table."""
    parts = []
    for name, (df, fields) in frames.items():
        missing = [F.count(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), 1)).alias(f) for f in fields]
        counted = df.agg(F.count("*").alias("total"), *missing)
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields)))
        parts.append(counted.select(F.lit(name).alias("entity"), "total", pairs.alias("p")).select("entity", "p.field", "total", "p.missing"))
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("missing") == 0, "PASS").otherwise("FAIL"))


def integrity(edges: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """Edges by type whose source or target is unknown: type -> (edges(src, dst), sources(id), targets(id))."""
    parts = []
    for name, (e, sources, targets) in edges.items():
        keyed = e.select("src", "dst").withColumn("n", F.lit(1))
        lost_src = keyed.join(sources.select(F.col("id").alias("src")), "src", "left_anti").agg(F.count("*").alias("no_source"))
        lost_dst = keyed.join(targets.select(F.col("id").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("no_target"))
        parts.append(lost_src.crossJoin(lost_dst).select(F.lit(name).alias("type"), "no_source", "no_target"))
    return reduce(DataFrame.unionByName, parts)


def duplicates(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Names that several rows share, whatever their case: groups and their members by entity."""
    parts = []
    for name, (df, field) in frames.items():
        groups = df.where(F.col(field).isNotNull()).groupBy(F.upper(field).alias("k")).agg(F.count("*").alias("c")).where("c > 1")
        parts.append(groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("members")).select(F.lit(name).alias("entity"), "groups", "members"))
    return reduce(DataFrame.unionByName, parts)


def outliers(rows: DataFrame, value: str, by: str, deviations: float = 3, sample: int = 10) -> DataFrame:
    """For each group: rows over mean + so many deviations of its positive values, with a few references."""
    stats = rows.where(F.col(value) > 0).groupBy(by).agg(F.avg(F.col(value).cast("double")).alias("m"), F.stddev_samp(F.col(value).cast("double")).alias("s"))
    over = rows.join(stats, by).where(F.col(value).cast("double") > F.col("m") + deviations * F.col("s"))
    ranked = over.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("ref")))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= sample, F.col("ref")))), ",").alias("sample_refs"))


def inventory(df: DataFrame) -> DataFrame:
    """Files of a file-based frame with their rows, and the newest one's time."""
    named = df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    return named.groupBy("file").agg(F.count("*").alias("n"), F.max("changed").alias("changed"))
