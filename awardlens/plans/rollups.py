"""Rollup and concentration queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from awardlens.operators import rollups as op
from awardlens.plans.registry import registry
from awardlens.sources.tables import FOCUS, Domain, oracle

QUERIES, ORACLES, query = registry()


@query(oracle("""SELECT office, round(CASE WHEN sum(v) > 0 THEN 10000.0 * sum(v * v) / (sum(v) * sum(v)) ELSE 0 END, 4) AS hhi, count(*) AS n_firms, round(sum(v), 2) AS val
FROM (SELECT office, firm, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1, 2) GROUP BY office"""))
def office_hhi(d: Domain):
    """Concentration of focus contracts among each office's firms."""
    return op.hhi(d.focus, ["office"])


@query(oracle("""SELECT office, hhi, CASE WHEN hhi >= 2500 THEN 'HIGH' WHEN hhi >= 1500 THEN 'MODERATE' ELSE 'LOW' END AS level, hhi > 130 AS concentrated FROM (
SELECT office, round(10000.0 * sum(v * v) / (sum(v) * sum(v)), 4) AS hhi FROM (SELECT office, firm, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1, 2) GROUP BY office)"""))
def hhi_levels(d: Domain, threshold: float = 130):
    """Level names, and a flag over a threshold that fits the mapped data."""
    found = op.hhi(d.focus, ["office"])
    return found.select("office", "hhi", op.concentration_level(F.col("hhi")).alias("level"), (F.col("hhi") > threshold).alias("concentrated"))


@query(oracle("""SELECT count(*) AS n_contracts, CAST(sum(amount) AS DOUBLE) AS val, count(*) FILTER (category = '1-URGENT') AS n_focus,
 CAST(coalesce(sum(amount) FILTER (category = '1-URGENT'), 0) AS DOUBLE) AS val_focus, (SELECT count(DISTINCT firm) FROM awards) AS n_firms, count(DISTINCT office) AS n_offices,
 min(award_date) AS first_date, max(award_date) AS last_date FROM contracts"""))
def headline_stats(d: Domain):
    """Totals on contracts, so that joint awards are not counted twice."""
    totals = d.contracts.agg(
        F.count("*").alias("n_contracts"),
        op.money(F.sum("amount")).alias("val"),
        F.count(op.when_focus(F.lit(1), FOCUS)).alias("n_focus"),
        op.money(F.sum(op.when_focus(F.col("amount"), FOCUS))).alias("val_focus"),
        F.count_distinct("office").alias("n_offices"),
        F.min("award_date").alias("first_date"),
        F.max("award_date").alias("last_date"),
    )
    return totals.crossJoin(d.awards.agg(F.count_distinct("firm").alias("n_firms")))


_ROLL = """count(*) AS n_all, CAST(sum(amount) AS DOUBLE) AS val_all, count(*) FILTER (category = '1-URGENT') AS n_focus,
 CAST(coalesce(sum(amount) FILTER (category = '1-URGENT'), 0) AS DOUBLE) AS val_focus, min(year) FILTER (category = '1-URGENT') AS first_focus_year"""


@query(oracle(f"SELECT firm, {_ROLL}, count(DISTINCT region) AS n_regions, count(DISTINCT year) AS n_years, count(DISTINCT office) AS n_offices FROM awards GROUP BY firm"))
def firm_rollup(d: Domain):
    return op.firm_rollup(d.awards, FOCUS)


@query(oracle(f"SELECT office, {_ROLL}, max_by(region, ref) AS region FROM (SELECT DISTINCT ref, office, region, category, amount, year FROM awards) GROUP BY office"))
def office_rollup(d: Domain):
    return op.office_rollup(d.awards, FOCUS)


@query(oracle("SELECT firm, office, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS val, min(year) AS first_year, max(year) AS last_year FROM awards GROUP BY 1, 2"))
def firm_office_rollup(d: Domain):
    return op.firm_office(d.awards)


@query(oracle("""SELECT x.firm AS a, y.firm AS b, count(*) AS n, CAST(sum(x.amount) AS DOUBLE) AS val, count(*) FILTER (x.category = '1-URGENT') AS n_focus,
 min(x.year) FILTER (x.category = '1-URGENT') AS first_focus_year FROM awards x JOIN awards y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2"""))
def co_award_pairs(d: Domain):
    return op.co_award_pairs(d.awards, FOCUS)


@query(oracle("""SELECT firm, category AS top_category, n AS n_top FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY n DESC, f, category) AS k
 FROM (SELECT firm, category, count(*) AS n, min(ref) AS f FROM awards GROUP BY 1, 2)) WHERE k = 1"""))
def firm_top_category(d: Domain):
    return op.top_category(d.awards)


@query(oracle("""SELECT s.office, firm, CAST(k AS INT) AS rank, n_awards, round(v, 2) AS val, round(CASE WHEN total > 0 THEN v / total ELSE 0 END, 6) AS share
 FROM (SELECT *, row_number() OVER (PARTITION BY office ORDER BY v DESC, firm) AS k, sum(v) OVER (PARTITION BY office) AS total
 FROM (SELECT office, firm, CAST(sum(amount) AS DOUBLE) AS v, count(*) AS n_awards FROM awards GROUP BY 1, 2)) s WHERE k <= 10"""))
def agency_concentration(d: Domain):
    """The ten largest firms of each office with their shares."""
    return op.top_shares(d.awards, "office", 10)


@query(oracle("SELECT office, count(DISTINCT ref) AS n_contracts, count(DISTINCT firm) AS n_firms, CAST(sum(amount) AS DOUBLE) AS val FROM awards GROUP BY 1"))
def spending_by_agency(d: Domain):
    return d.awards.groupBy("office").agg(F.count_distinct("ref").alias("n_contracts"), F.count_distinct("firm").alias("n_firms"), op.money(F.sum("amount")).alias("val"))


@query(oracle("SELECT firm, count(DISTINCT office) AS n_offices, count(*) AS n_awards, CAST(sum(amount) AS DOUBLE) AS val FROM awards GROUP BY 1 HAVING count(DISTINCT office) >= 2"))
def contractor_reach(d: Domain):
    found = d.awards.groupBy("firm").agg(F.count_distinct("office").alias("n_offices"), F.count("*").alias("n_awards"), op.money(F.sum("amount")).alias("val"))
    return found.where("n_offices >= 2")


@query(oracle("""SELECT c.ref, office, category, CAST(amount AS DOUBLE) AS amount, n_bids FROM contracts c JOIN (SELECT ref, count(*) AS n_bids FROM bids GROUP BY 1) b ON c.ref = b.ref
 WHERE n_bids = 1 OR category IN ('5-LOW', '4-NOT SPECI')"""))
def noncompetitive(d: Domain):
    """Contracts with one bidder or a non-competitive method."""
    count = d.bids.groupBy("ref").agg(F.count("*").alias("n_bids"))
    found = d.contracts.join(count, "ref").where((F.col("n_bids") == 1) | F.col("category").isin("5-LOW", "4-NOT SPECI"))
    return found.select("ref", "office", "category", F.col("amount").cast("double").alias("amount"), "n_bids")


@query(oracle("""SELECT region, n, round(v, 2) AS val, round(100 * v / (SELECT sum(v) FROM g), 4) AS share_pct FROM g WHERE region IS NOT NULL""",
 "g AS (SELECT CASE WHEN region <> 'ASIA' THEN region END AS region, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS v FROM contracts WHERE category = '1-URGENT' GROUP BY 1)"))
def geography_share(d: Domain):
    """Regional shares of focus value; one region counts as unmapped and only in the total."""
    rows = d.contracts.where(F.col("category") == FOCUS).withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    return op.region_share(rows)


@query(oracle("""SELECT office, CAST(k AS INT) AS k, firm, n FROM (SELECT office, firm, count(*) AS n, row_number() OVER (PARTITION BY firm ORDER BY count(*) DESC, office) AS k FROM focus GROUP BY 1, 2) WHERE k <= 6"""))
def firm_top_offices(d: Domain):
    """The six offices where a firm holds most focus contracts."""
    counted = d.focus.groupBy("office", "firm").agg(F.count("*").alias("n"))
    order = Window.partitionBy("firm").orderBy(F.desc("n"), "office")
    return counted.withColumn("k", F.row_number().over(order)).where("k <= 6").select("office", "k", "firm", "n")


@query(oracle("""SELECT firm, name, CAST(sum(amount) AS DOUBLE) AS val, count(*) AS n FROM awards JOIN firms USING (firm) GROUP BY 1, 2 ORDER BY val DESC, firm LIMIT 25"""))
def top_firms(d: Domain):
    """The 25 firms of the highest value."""
    sums = d.awards.groupBy("firm").agg(op.money(F.sum("amount")).alias("val"), F.count("*").alias("n"))
    return sums.join(d.firms.select("firm", "name"), "firm").orderBy(F.desc("val"), "firm").limit(25)
