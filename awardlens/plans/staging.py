"""Queries over staged rows: projection, merge map, load frames and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.operators import resolve
from awardlens.operators import staging as op
from awardlens.plans.registry import registry
from awardlens.sources import files
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()

_RAW = """SELECT CASE WHEN ref % 50 = 0 THEN '  ' ELSE ' C' || ref || ' ' END AS "contractId", 'Works ' || ref AS description, category, CASE WHEN ref % 3 = 0 THEN 'Dike' END AS "componentCategories",
 CASE ref % 5 WHEN 0 THEN 'Done' WHEN 1 THEN 'On-Going' WHEN 2 THEN 'Pending' WHEN 3 THEN 'Cancelled' END AS status, CASE WHEN ref % 7 = 0 THEN 'n/a' ELSE CAST(amount AS {text}) END AS budget, CAST(amount AS {text}) AS "amountPaid", '12.5' AS progress,
 CASE WHEN ref % 11 = 0 THEN '' ELSE 'Firm ' || ref % 100 END AS contractor, CASE WHEN ref % 13 = 0 THEN 'NaT' ELSE CAST(award_date AS {text}) || 'T00:00:00' END AS "startDate", NULL AS "completionDate", CAST(year AS {text}) AS "infraYear", 'Program ' || ref % 4 AS "programName", '' AS "sourceOfFunds",
 CASE WHEN ref % 6 = 0 THEN '{{"province": "", "region": null}}' WHEN ref % 10 = 0 THEN 'not json' ELSE '{{"province": "' || office || '", "region": "' || region || '"}}' END AS location, '14.5' AS latitude, 'x' AS longitude, ref % 2 = 0 AS "hasSatelliteImage", CASE WHEN ref % 4 = 0 THEN 'many' ELSE '3.0' END AS "reportCount", CAST(NULL AS BOOLEAN) AS "isLive", ref FROM contracts"""
RAW = "raw AS (" + _RAW.format(text="VARCHAR") + """),
staged AS (SELECT nullif(trim("contractId"), '') AS reference_number, description AS title, category, "componentCategories" AS component_categories,
 CASE status WHEN 'Done' THEN 'completed' WHEN 'On-Going' THEN 'on-going' WHEN 'Pending' THEN 'not yet started' WHEN 'Cancelled' THEN 'terminated' ELSE 'unknown' END AS status, TRY_CAST(budget AS DOUBLE) AS amount, TRY_CAST("amountPaid" AS DOUBLE) AS amount_paid, 12.5::DOUBLE AS progress,
 nullif(contractor, '') AS contractor_name, nullif(substr("startDate", 1, 10), 'NaT') AS start_date, CAST(NULL AS VARCHAR) AS completion_date, "infraYear" AS infra_year, "programName" AS program_name, CAST(NULL AS VARCHAR) AS source_of_funds,
 CASE WHEN ref % 6 <> 0 AND ref % 10 <> 0 THEN location->>'$.province' END AS province, CASE WHEN ref % 6 <> 0 AND ref % 10 <> 0 THEN location->>'$.region' END AS region, 14.5::DOUBLE AS latitude, CAST(NULL AS DOUBLE) AS longitude, "hasSatelliteImage" AS has_satellite_image,
 CASE WHEN ref % 4 <> 0 THEN 3::BIGINT END AS report_count, false AS is_live, 'portal' AS data_source, 'CC0-1.0' AS data_license, CASE WHEN ref % 6 <> 0 AND ref % 10 <> 0 THEN 'DPW - ' || (location->>'$.province') ELSE 'DPW' END AS procuring_entity FROM raw WHERE ref % 50 <> 0)"""


def staged(d: Domain) -> DataFrame:
    """Contracts as a portal writes them, staged."""
    named = _RAW.format(text="STRING").replace('"contractId"', "contractId")
    for c in ("componentCategories", "amountPaid", "startDate", "completionDate", "infraYear", "programName", "sourceOfFunds", "hasSatelliteImage", "reportCount", "isLive"):
        named = named.replace(f'"{c}"', c)
    raw = d.spark.sql(named.replace("{", "{{").replace("}", "}}").replace("FROM contracts", "FROM {contracts}"), contracts=d.contracts)
    return op.staged_contracts(raw, "portal", "CC0-1.0", "DPW")


@query(oracle("SELECT * FROM staged", RAW))
def staged_contracts(d: Domain):
    """The staged projection of raw contract rows, with the procuring entity."""
    return staged(d)


@query(oracle("SELECT label, id, name, value FROM (SELECT DISTINCT 'Agency' AS label, procuring_entity AS id, procuring_entity AS name, CAST(NULL AS DOUBLE) AS value FROM staged UNION SELECT 'Contractor', contractor_name, contractor_name, NULL FROM staged WHERE contractor_name IS NOT NULL UNION ALL SELECT 'Contract', reference_number, title, amount FROM staged)", RAW))
def loaded_nodes(d: Domain):
    """Agencies, contractors and contracts of the staged rows."""
    return op.load_nodes(staged(d))


@query(oracle("SELECT 'PROCURED' AS type, procuring_entity AS source, reference_number AS target FROM staged UNION ALL SELECT 'AWARDED_TO', reference_number, contractor_name FROM staged WHERE contractor_name IS NOT NULL", RAW))
def loaded_edges(d: Domain):
    """Agency to contract, contract to contractor."""
    return op.load_edges(staged(d))


@query(oracle("""SELECT CAST(step AS INT) AS step, label, n_rows FROM (SELECT 1 AS step, 'Municipality' AS label, count(*) AS n_rows FROM places UNION ALL SELECT 2, 'Agency', count(DISTINCT procuring_entity) FROM staged UNION ALL SELECT 3, 'Contractor', count(DISTINCT contractor_name) FROM staged
 UNION ALL SELECT 4, 'Contract', count(*) FROM staged UNION ALL SELECT 5, 'Politician', count(*) FROM officials UNION ALL SELECT 6, 'PoliticalFamily', count(*) FROM (SELECT DISTINCT surname, province FROM officials) UNION ALL SELECT 7, 'EDGES', count(*) + count(contractor_name) FROM staged)""", RAW))
def load_order(d: Domain):
    """Rows of each step of a full load: places, agencies, contractors, contracts, persons, families, edges."""
    rows = staged(d)
    nodes = op.load_nodes(rows)
    of = lambda label: nodes.where(F.col("label") == label)
    return op.ordered_load([("Municipality", d.places), ("Agency", of("Agency")), ("Contractor", of("Contractor")), ("Contract", of("Contract")), ("Politician", d.officials), ("PoliticalFamily", d.officials.select("surname", "province").distinct()), ("EDGES", op.load_edges(rows))])


@query(oracle("""SELECT 'contract_ref' AS constraint_name, 0::BIGINT AS n_keys, 0::BIGINT AS n_rows, (SELECT count(*) FROM contracts WHERE ref % 50 = 0) AS n_null UNION ALL SELECT * FROM (SELECT 'line_number', count(*), CAST(coalesce(sum(c), 0) AS BIGINT), 0 FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
 UNION ALL SELECT * FROM (SELECT 'agency_name', count(*), CAST(coalesce(sum(c), 0) AS BIGINT), 0 FROM (SELECT count(*) AS c FROM places GROUP BY office HAVING count(*) > 1))"""))
def constraint_violations(d: Domain):
    """Uniqueness of contract references, of line numbers and of agency names."""
    refs = d.contracts.select(F.when(F.col("ref") % 50 != 0, F.col("ref").cast("string")).alias("key"))
    lines = d.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return op.violations({"contract_ref": (refs, "key"), "line_number": (lines, "key"), "agency_name": (d.places, "office")})


@query(oracle("""SELECT ref, CASE WHEN firm % 3 = 0 THEN 'GROUP ' || home ELSE name END AS contractor_name, CASE WHEN firm % 3 = 0 THEN name END AS original_name FROM winners JOIN firms USING (firm)"""))
def merged_names(d: Domain):
    """Awards under the canonical names of a merge map."""
    merge_map = d.firms.where("firm % 3 = 0").select(F.col("name").alias("original"), F.concat(F.lit("GROUP "), "home").alias("canonical"))
    return op.merged_names(d.winners.join(d.firms, "firm").select("ref", F.col("name").alias("contractor_name")), merge_map)


@query(oracle("""SELECT a, b, similarity, CASE WHEN similarity >= 0.92 THEN 'auto' ELSE 'review' END AS tier, CASE WHEN similarity >= 0.92 THEN CASE WHEN length(a) >= length(b) THEN a ELSE b END END AS canonical FROM
 (SELECT x.name AS a, y.name AS b, round(jaro_winkler_similarity(x.name, y.name), 6) AS similarity FROM n x JOIN n y ON x.name < y.name) WHERE similarity >= 0.85""", "n AS (SELECT DISTINCT upper(p_brand || ' ' || p_type) AS name FROM part)"))
def merge_tiers(d: Domain):
    """Like names, merged at once or left to a reviewer by their similarity."""
    return op.match_tiers(resolve.fuzzy_matches(d.table("part").select(fn.company_name(F.concat_ws(" ", "p_brand", "p_type")).alias("name"))))


@query(oracle("""SELECT ref, CASE WHEN ref % 4 < 2 THEN CAST(amount AS DOUBLE) ELSE 0.0 END AS value, CASE WHEN ref % 4 = 0 THEN year END AS built, CASE WHEN ref % 4 = 0 THEN year END AS analysed FROM contracts"""))
def coerced_values(d: Domain):
    """Budgets that are no number count as zero; years outside either range are null."""
    kind = F.col("ref") % 4
    budget = F.when(kind < 2, F.col("amount").cast("string")).when(kind == 2, "NaN").otherwise("n/a")
    year = F.when(kind == 0, F.col("year").cast("string")).when(kind == 1, "1950").when(kind == 2, "soon")
    return d.contracts.select("ref", fn.number_or_zero(budget).alias("value"), fn.year_between(year, 1990, 2035).alias("built"), fn.year_between(year, 1990, 2030).alias("analysed"))


@query(oracle("""SELECT CAST(ref AS VARCHAR) AS reference_number, '' AS title, office AS procuring_entity, 'Firm ' || ref AS contractor_name, CAST(amount AS DOUBLE) AS amount, 'shopping' AS procurement_method, award_date, CASE WHEN status = 'F' THEN 'f' ELSE 'active' END AS status, 'export.csv' AS source_file FROM contracts WHERE ref % 9 <> 0 AND ref % 10 <> 0"""))
def export_records(d: Domain):
    """Records of an export under its own headers; rows without a reference or an entity are left out."""
    raw = d.contracts.select(F.when(F.col("ref") % 9 != 0, F.concat(F.lit(" "), F.col("ref").cast("string"))).alias("RefNo"), F.when(F.col("ref") % 10 != 0, F.col("office")).otherwise(" ").alias("PE"), F.concat(F.lit("Firm "), "ref").alias("awarded_to"), F.concat(F.lit("₱"), "amount").alias("ABC"), F.lit("Shopping - goods").alias("Method"), F.date_format("award_date", "MM/dd/yyyy").alias("Date of Award"), F.when(F.col("status") == "F", "F ").alias("Procurement Status"))
    return files.export_records(raw, "export.csv")


@query(oracle("SELECT DISTINCT office, 'O-' || substr(md5(office), 1, 12) AS office_id FROM places"))
def office_ids(d: Domain):
    """A stable id of each office by a hash of its name."""
    return d.places.select("office", F.concat(F.lit("O-"), F.substring(F.md5("office"), 1, 12)).alias("office_id")).distinct()


@query(oracle("""SELECT firm, name, home, CAST(n AS BIGINT) AS n, val FROM (SELECT firm, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS val FROM awards GROUP BY 1) JOIN firms USING (firm) WHERE contains(lower(name), '1') ORDER BY val DESC, firm LIMIT 200"""))
def firm_table(d: Domain, contains: str = "1", by: str = "val", n: int = 200):
    """Rows of a table whose name contains a text, sorted by a column, the first 200."""
    sums = d.awards.groupBy("firm").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val"))
    rows = sums.join(d.firms, "firm").where(F.lower("name").contains(contains)).select("firm", "name", "home", "n", "val")
    return rows.orderBy(F.desc(by), "firm").limit(n)


@query(oracle("""SELECT 'contracts' AS check_name, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS expected, CAST((SELECT count(*) FROM contracts) AS DOUBLE) AS found, (SELECT count(*) FROM orders) = (SELECT count(*) FROM contracts) AS agrees
 UNION ALL SELECT 'value', (SELECT CAST(sum(amount) AS DOUBLE) FROM contracts), (SELECT CAST(sum(v) AS DOUBLE) FROM (SELECT sum(amount) AS v FROM contracts GROUP BY office)), true
 UNION ALL SELECT 'focus', (SELECT CAST(count(DISTINCT ref) AS DOUBLE) FROM focus), (SELECT CAST(sum(n) AS DOUBLE) FROM (SELECT count(DISTINCT ref) AS n FROM focus GROUP BY office)), true"""))
def reconciliation(d: Domain):
    """Totals taken in two ways that must agree: contracts, their value, focus contracts by office."""
    c = d.contracts
    pairs = {
        "contracts": (d.table("orders").agg(F.count("*").cast("double").alias("x")), c.agg(F.count("*").cast("double").alias("y"))),
        "value": (c.agg(F.sum("amount").cast("double").alias("x")), c.groupBy("office").agg(F.sum("amount").alias("v")).agg(F.sum("v").cast("double").alias("y"))),
        "focus": (d.focus.agg(F.count_distinct("ref").cast("double").alias("x")), d.focus.groupBy("office").agg(F.count_distinct("ref").alias("n")).agg(F.sum("n").cast("double").alias("y"))),
    }
    rows = [x.crossJoin(y).select(F.lit(name).alias("check_name"), F.col("x").alias("expected"), F.col("y").alias("found"), (F.col("x") == F.col("y")).alias("agrees")) for name, (x, y) in pairs.items()]  # one row each
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(oracle("""SELECT vec_id AS entity_id, label, CAST(list_sum(embedding) > 0 AS BOOLEAN) AS positive, 'new' AS origin FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 5 <> 0 UNION ALL SELECT vec_id, label, CAST(list_sum(embedding) > 0 AS BOOLEAN), 'old' FROM embeddings WHERE NOT (vec_id % 3 = 0 AND vec_id % 5 <> 0)"""))
def vector_upsert(d: Domain):
    """Vectors with a batch of new ones, of which some have no vector."""
    v = d.table("embeddings").select(F.col("vec_id").alias("entity_id"), "label", "embedding")
    new = v.where("entity_id % 3 = 0").withColumn("embedding", F.when(F.col("entity_id") % 5 != 0, F.col("embedding"))).withColumn("origin", F.lit("new"))
    both = op.vector_upsert(v.withColumn("origin", F.lit("old")), new)
    return both.select("entity_id", "label", (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) > 0).alias("positive"), "origin")
