"""Queries over rates of events and over header variants of raw exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from awardlens.plans.registry import registry
from awardlens.sources import files
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()


@query(oracle("""SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)"""))
def trailing_requests(d: Domain):
    """Events of a user in the trailing hour, the limiter's unconditional count."""
    e = d.table("events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)).alias("trailing"))


@query(oracle("""SELECT CAST(ref AS VARCHAR) AS reference_number, CAST(NULL AS VARCHAR) AS title, office AS procuring_entity, CAST(NULL AS VARCHAR) AS contractor_name, CAST(amount AS VARCHAR) AS amount, category AS procurement_method, CAST(award_date AS VARCHAR) AS award_date, status FROM contracts"""))
def detected_columns(d: Domain):
    """Contracts under an export's headers, found by their variants."""
    raw = d.contracts.select(F.col("ref").cast("string").alias("Reference No"), F.col("office").alias("AGENCY"), F.col("amount").cast("string").alias("Contract Amount"), F.col("category").alias("Mode of Procurement"), F.col("award_date").cast("string").alias("Date Awarded"), F.col("status").alias("Status"))
    return files.detected(raw)


@query(oracle("""SELECT office, region, count(*) AS n FROM (SELECT CASE WHEN ref % 6 = 0 THEN 'Unspecified office' ELSE office END AS office, CASE WHEN ref % 10 = 0 THEN 'Unspecified region' ELSE region END AS region FROM contracts) GROUP BY 1, 2"""))
def nested_location(d: Domain):
    """Places out of JSON strings, where empty and missing parts get a default."""
    province = F.when(F.col("ref") % 6 == 0, F.lit("")).otherwise(F.col("office"))
    raw = d.contracts.select(F.to_json(F.struct(province.alias("province"), F.when(F.col("ref") % 10 != 0, F.col("region")).alias("region"))).alias("location"))
    return files.location(raw).groupBy("office", "region").agg(F.count("*").alias("n"))


@query(oracle("""SELECT substr(code, 1, 2) AS region_code, CASE WHEN substr(code, 3) = '0000000' THEN 'region' WHEN substr(code, 5) = '00000' THEN 'province' WHEN substr(code, 7) = '000' THEN 'municipality' ELSE 'barangay' END AS level, count(*) AS n
 FROM (SELECT lpad(CAST(CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey % 17) * 10000000 WHEN s_suppkey % 5 = 1 THEN (s_suppkey % 1700 + 1) * 100000 WHEN s_suppkey % 5 = 2 THEN (s_suppkey % 170000 + 100001) * 1000 ELSE s_suppkey * 7 + 130000001 END AS VARCHAR), 9, '0') AS code FROM supplier) GROUP BY 1, 2"""))
def place_codes(d: Domain):
    """Levels of nine-digit place codes by their trailing zeros."""
    k = F.col("s_suppkey")
    number = F.when(k % 5 == 0, (k % 17) * 10_000_000).when(k % 5 == 1, (k % 1700 + 1) * 100_000).when(k % 5 == 2, (k % 170_000 + 100_001) * 1000).otherwise(k * 7 + 130_000_001)
    code = F.lpad(number.cast("string"), 9, "0")
    tail = lambda n: F.substring(code, n, 9)
    level = F.when(tail(3) == "0000000", "region").when(tail(5) == "00000", "province").when(tail(7) == "000", "municipality").otherwise("barangay")
    return d.table("supplier").groupBy(F.substring(code, 1, 2).alias("region_code"), level.alias("level")).agg(F.count("*").alias("n"))
