"""Profiles, reports and texts of entities: details with neighbours, shares, histograms, descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.operators import flags as flag_op
from awardlens.operators import graph, quality, rollups
from awardlens.operators import temporal as temporal_op
from awardlens.plans import flags as flag_plans
from awardlens.plans import temporal as temporal_plans
from awardlens.plans.flags import MORE
from awardlens.plans.network import PAIRS, REACH, focus_pairs
from awardlens.plans.registry import registry
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()
_SORTED = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")


def _first(d: Domain) -> DataFrame:
    """The smallest firm, one row."""
    return F.broadcast(d.firms.agg(F.min("firm").alias("firm")))


# ------------------------------------------------------------------ nodes and neighbours


@query(oracle("""SELECT firm, name, home, (SELECT count(*) FROM awards a WHERE a.firm = f.firm) AS n_awards, (SELECT CAST(sum(amount) AS DOUBLE) FROM awards a WHERE a.firm = f.firm) AS val,
 (SELECT string_agg(dst, ',' ORDER BY dst) FROM (SELECT dst FROM und WHERE src = f.firm ORDER BY dst LIMIT 50)) AS neighbours FROM firms f WHERE firm = (SELECT min(firm) FROM firms)""", PAIRS))
def node_detail(d: Domain, most: int = 50):
    """A firm with its first fifty neighbours and its totals."""
    one = d.firms.join(_first(d), "firm", "left_semi")
    near = graph.undirected(focus_pairs(d)).join(_first(d), F.col("src") == F.col("firm"), "left_semi").select("dst").orderBy("dst").limit(most)
    listed = near.agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("neighbours"))
    sums = d.awards.join(_first(d), "firm", "left_semi").groupBy("firm").agg(F.count("*").alias("n_awards"), F.sum("amount").cast("double").alias("val"))
    return one.join(sums, "firm", "left").crossJoin(F.broadcast(listed)).select("firm", "name", "home", "n_awards", "val", "neighbours")  # one row each


@query(oracle("SELECT src, dst, weight FROM pairs WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)", PAIRS + ", ids AS (SELECT min(src) AS id FROM und UNION SELECT dst FROM und WHERE src = (SELECT min(src) FROM und))"))
def subgraph_edges(d: Domain):
    """The relationships among all nodes within one step of the first firm."""
    e = focus_pairs(d).select("src", "dst", "weight")
    near = graph.distances(e, e.agg(F.min(F.least("src", "dst"))).first()[0], 1).select("id")
    return e.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


_EDGES = PAIRS + """, edges AS (SELECT 'AWARDED_TO' AS type, 'F' || firm AS source, 'O-' || office AS target FROM focus GROUP BY 2, 3 UNION ALL SELECT 'CO_AWARDED_WITH', 'F' || src, 'F' || dst FROM pairs)"""


def _edges(d: Domain) -> DataFrame:
    held = d.focus.select(F.lit("AWARDED_TO").alias("type"), F.concat(F.lit("F"), "firm").alias("source"), F.concat(F.lit("O-"), "office").alias("target")).distinct()
    return held.unionByName(focus_pairs(d).select(F.lit("CO_AWARDED_WITH").alias("type"), F.concat(F.lit("F"), "src").alias("source"), F.concat(F.lit("F"), "dst").alias("target")))


@query(oracle("SELECT target AS id FROM edges WHERE type = 'AWARDED_TO' AND source = (SELECT min(source) FROM edges) ORDER BY id LIMIT 10 OFFSET 2", _EDGES))
def neighbors_of_type(d: Domain, kind: str = "AWARDED_TO", page: int = 10, skip: int = 2):
    """One page of a node's neighbours over one type of edge."""
    e = _edges(d)
    seed = F.broadcast(e.agg(F.min("source").alias("seed")))
    return e.where(F.col("type") == kind).join(seed, F.col("source") == F.col("seed"), "left_semi").select(F.col("target").alias("id")).orderBy("id").offset(skip).limit(page)


@query(oracle("SELECT * FROM edges WHERE type <> 'AWARDED_TO' AND source NOT LIKE 'O-%' AND target NOT LIKE 'O-%'", _EDGES))
def displayed_edges(d: Domain):
    """Edges left when offices and their awards are hidden."""
    office = F.col("source").startswith("O-") | F.col("target").startswith("O-")
    return _edges(d).where((F.col("type") != "AWARDED_TO") & ~office)


@query(oracle("""SELECT 'F' || firm AS id, 'Contractor' AS kind, name AS label, home AS place FROM firms UNION ALL SELECT DISTINCT 'O-' || office, 'ProcuringEntity', office, region FROM places UNION ALL SELECT 'P' || person, 'Person', surname, province FROM officials"""))
def all_nodes(d: Domain):
    """Firms, offices and persons as one table of nodes."""
    firms = d.firms.select(F.concat(F.lit("F"), "firm").alias("id"), F.lit("Contractor").alias("kind"), F.col("name").alias("label"), F.col("home").alias("place"))
    offices = d.places.select(F.concat(F.lit("O-"), "office").alias("id"), F.lit("ProcuringEntity").alias("kind"), F.col("office").alias("label"), F.col("region").alias("place")).distinct()
    persons = d.officials.select(F.concat(F.lit("P"), "person").alias("id"), F.lit("Person").alias("kind"), F.col("surname").alias("label"), F.col("province").alias("place"))
    return firms.unionByName(offices).unionByName(persons, allowMissingColumns=True)


@query(oracle("""SELECT ref, CASE ref % 4 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Agency' ELSE 'Person' END AS node_kind, CASE ref % 4 WHEN 0 THEN 'PROCURED' WHEN 1 THEN 'OWNED_BY' ELSE 'AWARDED_TO' END AS edge_kind FROM contracts"""))
def kind_fallbacks(d: Domain):
    """Unknown labels count as persons, unknown edge types as awards."""
    node = F.when(F.col("ref") % 4 == 0, "contract").when(F.col("ref") % 4 == 1, "agency").when(F.col("ref") % 4 == 2, "thing")
    edge = F.when(F.col("ref") % 4 == 0, "PROCURED").when(F.col("ref") % 4 == 1, "OWNED_BY").when(F.col("ref") % 4 == 2, "KNOWS")
    nodes = F.create_map(*(F.lit(x) for x in ("contract", "Contract", "agency", "Agency", "contractor", "Contractor")))
    edges = F.create_map(*(F.lit(x) for k in ("PROCURED", "OWNED_BY", "AWARDED_TO") for x in (k, k)))
    return d.contracts.select("ref", F.coalesce(nodes[node], F.lit("Person")).alias("node_kind"), F.coalesce(edges[edge], F.lit("AWARDED_TO")).alias("edge_kind"))


# ------------------------------------------------------------------ concentration and red flags


@query(oracle("""SELECT office, round(hhi, 4) AS hhi, CASE WHEN hhi >= 2500 THEN 'HIGH' WHEN hhi >= 1500 THEN 'MODERATE' ELSE 'LOW' END AS level, shares, top_firm FROM
 (SELECT office, 10000.0 * sum(v * v) / (sum(v) * sum(v)) AS hhi, max_by(firm, (v, -firm)) AS top_firm FROM s GROUP BY 1) JOIN
 (SELECT office, string_agg(firm || ':' || n, ',' ORDER BY k) AS shares FROM (SELECT *, row_number() OVER (PARTITION BY office ORDER BY v DESC, firm) AS k FROM s) WHERE k <= 5 GROUP BY 1) USING (office)""", "s AS (SELECT office, firm, CAST(sum(amount) AS DOUBLE) AS v, count(*) AS n FROM awards GROUP BY 1, 2)"))
def concentration_shares(d: Domain):
    """Each office's index and level with its five largest firms, and the firm of the largest share."""
    index = rollups.hhi(d.awards, ["office"])
    top = rollups.top_shares(d.awards, "office", 5)
    # the rank goes by the whole value; the share is rounded, and firms of a large office have it in common
    listed = top.groupBy("office").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", "firm", "n_awards").alias("t")))).alias("x"), F.min_by("firm", "rank").alias("top_firm"))
    return index.join(listed, "office").select("office", "hhi", rollups.concentration_level(F.col("hhi")).alias("level"), F.array_join(F.transform("x", lambda v: v["t"]), ",").alias("shares"), "top_firm")


@query(oracle("""SELECT office, string_agg(category || ':' || n, ',' ORDER BY category) AS methods FROM (SELECT office, category, count(*) AS n FROM contracts GROUP BY 1, 2) GROUP BY 1"""))
def methods_by_office(d: Domain):
    """Contracts by procurement method of each office."""
    counted = d.contracts.groupBy("office", "category").agg(F.count("*").alias("n"))
    return counted.groupBy("office").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "category", "n"))), ",").alias("methods"))


@query(oracle("""SELECT firm, home, regions, n, val FROM (SELECT firm, home, string_agg(DISTINCT region, ',' ORDER BY region) AS regions, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS val FROM awards JOIN firms USING (firm) WHERE region <> home_region GROUP BY 1, 2 HAVING count(*) >= 3)"""))
def away_regions(d: Domain):
    """Firms with three awards or more outside their home region, with those regions."""
    away = d.awards.join(d.firms.select("firm", "home", "home_region"), "firm").where("region <> home_region")
    return away.groupBy("firm", "home").agg(_SORTED("region").alias("regions"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("val")).where("n >= 3")


@query(oracle("""SELECT office, count(*) OVER w AS n, CAST(sum(amount) OVER w AS DOUBLE) AS val, ref, CAST(row_number() OVER (PARTITION BY office ORDER BY ref) AS INT) AS place FROM contracts WHERE amount > 100000 AND CAST(floor(amount) AS BIGINT) % 500 = 0 WINDOW w AS (PARTITION BY office)"""))
def round_amount_list(d: Domain):
    """Contracts of round amounts by office, a row each, with how many the office has and their total."""
    whole = d.contracts.where((F.col("amount") > 100_000) & (F.floor("amount") % 500 == 0))
    totals = whole.groupBy("office").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val"))
    placed = whole.select("office", "ref").withColumn("place", F.row_number().over(Window.partitionBy("office").orderBy("ref")))
    return placed.join(totals, "office").select("office", "n", "val", "ref", "place")


@query(oracle(f"""SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS weight, flag || ': ' || entity_type || ' ' || entity_id || ' (' || n || ')' AS description,
 to_json({{'n': n, 'val': CAST(val AS VARCHAR)}}) AS evidence, '2024-01-01' AS detected_at FROM (SELECT flag, severity, entity_type, entity_id, n, CAST(CAST(val AS DECIMAL(20,2)) AS VARCHAR) AS val FROM ({flag_plans.ALL}))
 WHERE severity IN ('high', 'medium') ORDER BY weight DESC, flag, entity_id, n, val LIMIT 100""", MORE))
def red_flag_report(d: Domain, severities: tuple[str, ...] = ("high", "medium"), detected_at: str = "2024-01-01", n: int = 100):
    """Flags of some severities with description, evidence and day, the gravest first."""
    return flag_op.reported(flag_plans.all_flags(d), severities, detected_at).orderBy(F.desc("weight"), "flag", "entity_id", "n", "val").limit(n)


@query(oracle(f"""SELECT entity_type, entity_id, risk_score, n_flags, flags FROM (SELECT entity_type, entity_id, CAST(sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS risk_score, count(*) AS n_flags,
 string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags, bool_or(severity = 'critical') AS asked FROM ({flag_plans.ALL}) GROUP BY 1, 2) WHERE asked ORDER BY risk_score DESC, entity_type, entity_id LIMIT 50""", MORE))
def red_flag_items(d: Domain, severity: str | None = "critical", n: int = 50):
    """Entities with a flag of a severity (or any), all their flags of the thirteen detectors weighed, the riskiest first."""
    return flag_op.flagged_entities(flag_plans.all_flags(d), severity).orderBy(F.desc("risk_score"), "entity_type", "entity_id").limit(n)


_AUDIT = "audit AS (SELECT event_id, event_type AS kind, props AS description, value AS amount FROM events)"


@query(oracle("""SELECT 'bid_rigging' AS topic, kind, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS val FROM audit WHERE contains(kind, 'bid') OR contains(kind, 'rigging') OR contains(description, 'bid') OR kind = 'purchase' GROUP BY kind
 UNION ALL SELECT 'overpricing', kind, count(*), CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM audit WHERE contains(kind, 'pric') OR contains(description, 'above market') OR contains(description, 'overpr') OR contains(kind, 'click') GROUP BY kind
 UNION ALL SELECT 'unliquidated', kind, count(*), CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM audit WHERE contains(kind, 'unliq') OR contains(description, 'unliq') OR contains(description, 'cash advance') OR contains(kind, 'view') GROUP BY kind""", _AUDIT))
def audit_topics(d: Domain):
    """Findings by three sets of words in their type or text; each set has one type of the test events added."""
    rows = d.table("events").select(F.col("event_type").alias("kind"), F.col("props").alias("description"), F.col("value").cast("decimal(18,2)").alias("amount"))
    return flag_op.audit_topics(rows, {"bid_rigging": (("bid", "rigging"), ("bid",), "purchase"), "overpricing": (("pric", "click"), ("above market", "overpr"), None), "unliquidated": (("unliq", "view"), ("unliq", "cash advance"), None)})


@query(oracle("""SELECT office, a, b FROM (SELECT x.office, x.firm AS a, y.firm AS b FROM fo x JOIN fo y ON x.office = y.office AND x.firm < y.firm) JOIN pairs ON src = a AND dst = b""", PAIRS + ", fo AS (SELECT DISTINCT office, firm FROM focus)"))
def linked_winners(d: Domain):
    """Pairs of an office's winners with joint awards."""
    held = d.focus.select("office", "firm").distinct()
    strong = focus_pairs(d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    left = strong.join(held.withColumnRenamed("firm", "a"), "a")
    return left.join(held.withColumnRenamed("firm", "b"), ["b", "office"]).select("office", "a", "b")


@query(oracle("""SELECT threshold, office, anchor, n, val FROM (SELECT t AS threshold, x.office, x.ref AS anchor, count(*) AS n, CAST(sum(y.amount) AS DOUBLE) AS val FROM (VALUES (50000), (150000), (250000)) AS v(t), focus_c x JOIN focus_c y ON x.office = y.office
 WHERE x.amount >= 0.7 * t AND x.amount < t AND y.amount >= 0.7 * t AND y.amount < t AND (y.award_date > x.award_date OR (y.award_date = x.award_date AND y.ref >= x.ref)) AND date_diff('day', x.award_date, y.award_date) <= 30 AND y.amount BETWEEN x.amount * 0.5 AND x.amount * 2 GROUP BY 1, 2, 3 HAVING count(*) >= 2)""", "focus_c AS (SELECT * FROM contracts)"))
def split_clusters_by_threshold(d: Domain, thresholds: tuple[int, ...] = (50_000, 150_000, 250_000)):
    """Clusters of near contracts under each of three thresholds."""
    return reduce(DataFrame.unionByName, (flag_op.split_clusters(d.contracts, t).select(F.lit(t).alias("threshold"), "office", "anchor", "n", "val") for t in thresholds))


# ------------------------------------------------------------------ firms, agencies, persons


@query(oracle("""SELECT firm, n, categories, revoked, former FROM (SELECT firm, count(*) AS n FROM awards GROUP BY 1) JOIN (SELECT firm, string_agg(category || ':' || c, ',' ORDER BY category) AS categories FROM (SELECT firm, category, count(*) AS c FROM awards GROUP BY 1, 2) GROUP BY 1) USING (firm)
 JOIN (SELECT firm, bool_or(ref % 500 = 0) AS revoked, 'Old ' || min(ref) FILTER (ref % 7 = 0) AS former FROM awards GROUP BY 1) USING (firm)"""))
def firm_histogram(d: Domain):
    """Each firm's awards by category, whether a cell calls it revoked, and the first former name."""
    counted = d.awards.groupBy("firm", "category").agg(F.count("*").alias("c"), F.bool_or(F.col("ref") % 500 == 0).alias("revoked"), F.min(F.when(F.col("ref") % 7 == 0, F.col("ref"))).alias("first"))
    rows = counted.groupBy("firm").agg(F.sum("c").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "category", "c"))), ",").alias("categories"), F.bool_or("revoked").alias("revoked"), F.min("first").alias("first"))
    return rows.select("firm", "n", "categories", "revoked", F.concat(F.lit("Old "), F.col("first").cast("string")).alias("former"))


@query(oracle("""SELECT office AS name, 'Department ' || region AS department, count(*) AS total_contracts, round(CAST(sum(amount) AS DOUBLE), 2) AS total_value FROM contracts GROUP BY 1, 2"""))
def agency_extract(d: Domain):
    """Agencies with their department and totals."""
    return d.contracts.groupBy(F.col("office").alias("name"), F.concat(F.lit("Department "), "region").alias("department")).agg(F.count("*").alias("total_contracts"), F.round(F.sum("amount").cast("double"), 2).alias("total_value"))


@query(oracle("""SELECT firm, office, n_bids, n_wins, round(n_wins / n_bids, 6) AS win_rate FROM (SELECT b.firm, office, count(*) AS n_bids, count(*) FILTER (winner = b.firm) AS n_wins FROM bids b JOIN contracts USING (ref) JOIN (SELECT ref, arg_min(firm, (bid, firm)) AS winner FROM bids GROUP BY 1) w USING (ref) GROUP BY 1, 2)"""))
def wins_by_agency(d: Domain):
    """Bids, wins and win rate of each firm at each office."""
    lowest = d.bids.groupBy("ref").agg(F.min_by("firm", F.struct("bid", "firm")).alias("winner"))
    rows = d.bids.join(lowest, "ref").join(d.contracts.select("ref", "office"), "ref").groupBy("firm", "office").agg(F.count("*").alias("n_bids"), F.count(F.when(F.col("winner") == F.col("firm"), 1)).alias("n_wins"))
    return rows.withColumn("win_rate", F.round(F.col("n_wins") / F.col("n_bids"), 6))


@query(oracle("""SELECT ref, office, firm, amount FROM (SELECT ref, office, firm, CAST(amount AS DOUBLE) AS amount FROM awards WHERE firm = (SELECT min(firm) FROM firms) AND office = (SELECT min(office) FROM places) ORDER BY amount DESC, ref LIMIT 15)"""))
def agency_contractor_contracts(d: Domain, n: int = 15):
    """The fifteen largest contracts of one firm with one office."""
    office = F.broadcast(d.places.agg(F.min("office").alias("office")))
    rows = d.awards.join(_first(d), "firm", "left_semi").join(office, "office", "left_semi")
    return rows.select("ref", "office", "firm", F.col("amount").cast("double").alias("amount")).orderBy(F.desc("amount"), "ref").limit(n)


@query(oracle("""SELECT person, year, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS declared FROM (SELECT user_id AS person, CAST(year(ts) AS INT) AS year, value FROM events) JOIN (SELECT person FROM officials) USING (person) GROUP BY 1, 2"""))
def declared_timeline(d: Domain):
    """Declared values of each person by year."""
    e = d.table("events").select(F.col("user_id").alias("person"), F.year("ts").alias("year"), F.col("value").cast("decimal(18,2)").alias("v"))
    return e.join(d.officials.select("person"), "person", "left_semi").groupBy("person", "year").agg(F.sum("v").cast("double").alias("declared"))


@query(oracle("""SELECT person, surname, members, n_bills FROM (SELECT customer AS person, count(*) AS n_bills FROM contracts GROUP BY 1) JOIN officials USING (person) JOIN (SELECT surname, province, count(*) AS members FROM officials GROUP BY 1, 2 HAVING count(*) >= 2) USING (surname, province)"""))
def bills_by_families(d: Domain):
    """Works of persons whose family has two members in office or more; orders stand for bills."""
    works = d.contracts.groupBy(F.col("customer").alias("person")).agg(F.count("*").alias("n_bills"))
    families = d.officials.groupBy("surname", "province").agg(F.count("*").alias("members")).where("members >= 2")
    return works.join(d.officials, "person").join(families, ["surname", "province"]).select("person", "surname", "members", "n_bills")


@query(oracle("""SELECT firm, round(v / capital, 4) AS contract_to_capital, twins FROM (SELECT firm, name, home, CAST(capital AS DOUBLE) AS capital, count(*) OVER (PARTITION BY home, firm % 7) - 1 AS twins FROM firms) JOIN (SELECT firm, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1) USING (firm) WHERE capital > 0"""))
def capital_ratio(d: Domain):
    """Focus value over paid-up capital, and other firms registered at the same address."""
    address = F.concat_ws("-", "home", (F.col("firm") % 7).cast("string"))
    twins = d.firms.groupBy(address.alias("address")).agg((F.count("*") - 1).alias("twins"))
    sums = d.focus.groupBy("firm").agg(F.sum("amount").cast("double").alias("v"))
    rows = d.firms.where("capital > 0").withColumn("address", address).join(twins, "address").join(sums, "firm")
    return rows.select("firm", F.round(F.col("v") / F.col("capital").cast("double"), 4).alias("contract_to_capital"), "twins")


@query(oracle("""SELECT 'F' || firm AS id, 'firm' AS kind, name AS label, coalesce(v, 0.0) AS val, cat AS detail FROM firms LEFT JOIN (SELECT firm, CAST(sum(amount) AS DOUBLE) AS v, NULL AS z FROM focus GROUP BY 1) USING (firm) LEFT JOIN (SELECT firm, arg_max(category, (c, category)) AS cat FROM (SELECT firm, category, count(*) AS c FROM awards GROUP BY 1, 2) GROUP BY 1) USING (firm)
 UNION ALL SELECT 'O-' || office, 'office', office, CAST(sum(amount) AS DOUBLE), region FROM contracts WHERE category = '1-URGENT' GROUP BY office, region UNION ALL SELECT 'P' || person, 'person', surname || ' ' || person, CAST(net_worth AS DOUBLE), position FROM officials"""))
def search_index(d: Domain):
    """Rows to search: firms with value and main category, offices, persons."""
    sums = d.focus.groupBy("firm").agg(F.sum("amount").cast("double").alias("v"))
    top = d.awards.groupBy("firm", "category").agg(F.count("*").alias("c")).groupBy("firm").agg(F.max_by("category", F.struct("c", "category")).alias("detail"))
    firms = d.firms.join(sums, "firm", "left").join(top, "firm", "left").select(F.concat(F.lit("F"), "firm").alias("id"), F.lit("firm").alias("kind"), F.col("name").alias("label"), F.coalesce("v", F.lit(0.0)).alias("val"), "detail")
    offices = d.contracts.where("category = '1-URGENT'").groupBy("office", "region").agg(F.sum("amount").cast("double").alias("val")).select(F.concat(F.lit("O-"), "office").alias("id"), F.lit("office").alias("kind"), F.col("office").alias("label"), "val", F.col("region").alias("detail"))
    persons = d.officials.select(F.concat(F.lit("P"), "person").alias("id"), F.lit("person").alias("kind"), F.concat_ws(" ", "surname", "person").alias("label"), F.col("net_worth").cast("double").alias("val"), F.col("position").alias("detail"))
    return firms.unionByName(offices).unionByName(persons)


# ------------------------------------------------------------------ signals over years


@query(oracle("SELECT *, count(*) OVER () AS n_all FROM feet ORDER BY val DESC, a, b LIMIT 12", temporal_plans.FOOT))
def footprint_top(d: Domain, n: int = 12):
    """The twelve pairs of like footprints with most value, and how many there are in all."""
    d.keep("focus")
    return temporal_op.best_footprints(d.focus, *temporal_plans.FEET, n)


@query(oracle("""SELECT component, n_nodes, CAST(v AS DOUBLE) AS val FROM (SELECT component, count(*) AS n_nodes FROM comp GROUP BY 1) JOIN (SELECT component, sum(amount) AS v FROM focus JOIN comp ON firm = id GROUP BY 1) USING (component) WHERE n_nodes BETWEEN 3 AND 1500 ORDER BY val DESC, component LIMIT 10""", REACH))
def jv_groups_top(d: Domain, smallest: int = 3, largest: int = 1500, n: int = 10):
    """The ten groups of joint bidders with most value among those of a size."""
    comp = graph.components(focus_pairs(d))
    value = d.focus.join(comp, F.col("firm") == F.col("id")).groupBy("component").agg(F.sum("amount").cast("double").alias("val"))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n_nodes")).where(F.col("n_nodes").between(smallest, largest))
    return sizes.join(value, "component").select("component", "n_nodes", "val").orderBy(F.desc("val"), "component").limit(n)


@query(oracle("""SELECT year, n, val, active_offices, concentrated_offices FROM (SELECT year, count(DISTINCT ref) AS n FROM focus GROUP BY 1) JOIN (SELECT year, round(CAST(sum(amount) AS DOUBLE), 2) AS val FROM contracts WHERE category = '1-URGENT' AND ref IN (SELECT ref FROM winners) GROUP BY 1) USING (year)
 LEFT JOIN (SELECT year, count(*) AS active_offices, count(*) FILTER (hhi > 400) AS concentrated_offices FROM (SELECT year, office, count(DISTINCT ref) AS c FROM focus GROUP BY 1, 2) JOIN (SELECT year, office, 10000.0 * sum(v * v) / (sum(v) * sum(v)) AS hhi FROM (SELECT year, office, firm, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (year, office) WHERE c >= 5 GROUP BY year) USING (year)"""))
def yearly_series(d: Domain):
    """Contracts, value, active and concentrated offices of each year in one series."""
    once = d.focus.select("ref", "year", "amount").distinct().groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("amount").cast("double"), 2).alias("val"))
    return once.join(temporal_op.concentrated_by_year(d.focus, 5, 400), "year", "left").select("year", "n", "val", "active_offices", "concentrated_offices")


# ------------------------------------------------------------------ texts


@query(oracle("""SELECT 'contractor' AS kind, CAST(firm AS VARCHAR) AS id, name || ' is a contractor based in ' || home || ' with ' || n || ' contracts.' AS text FROM firms JOIN (SELECT firm, count(*) AS n FROM awards GROUP BY 1) USING (firm)
 UNION ALL SELECT 'agency', office, office || ' is a district agency under ' || region || '.' FROM places UNION ALL SELECT 'contract', CAST(ref AS VARCHAR), 'Contract ' || ref || CASE WHEN ref % 2 = 0 THEN ' via ' || category ELSE '' END || ' awarded on ' || award_date || '.' FROM contracts
 UNION ALL SELECT 'politician', CAST(person AS VARCHAR), surname || ' serves as ' || position || ' representing ' || province || '.' FROM officials UNION ALL SELECT 'municipality', CAST(nation_key AS VARCHAR), office || ' , ' || region || '.' FROM places
 UNION ALL SELECT 'family', surname || '/' || province, 'The ' || surname || ' family in ' || province || ' has ' || count(*) || ' members in public office.' FROM officials GROUP BY surname, province"""))
def described_entities(d: Domain):
    """A sentence for each node of six kinds; parts without a value are left out."""
    n = d.awards.groupBy("firm").agg(F.count("*").alias("total_contracts"))
    frames = {
        "contractor": d.firms.join(n, "firm").select(F.col("firm").cast("string").alias("id"), "name", F.col("home").alias("address"), "total_contracts"),
        "agency": d.places.select(F.col("office").alias("id"), F.col("office").alias("name"), F.lit("district").alias("type"), F.col("region").alias("department")),
        "contract": d.contracts.select(F.col("ref").cast("string").alias("id"), F.col("ref").cast("string").alias("name"), F.when(F.col("ref") % 2 == 0, F.col("category")).alias("procurement_method"), F.col("award_date").cast("string").alias("award_date")),
        "politician": d.officials.select(F.col("person").cast("string").alias("id"), F.col("surname").alias("name"), "position", "province"),
        "municipality": d.places.select(F.col("nation_key").cast("string").alias("id"), F.col("office").alias("name"), "region"),
        "family": d.officials.groupBy("surname", "province").agg(F.count("*").alias("member_count")).select(F.concat_ws("/", "surname", "province").alias("id"), F.col("surname").alias("name"), "province", "member_count"),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), "id", fn.description(kind, df.columns).alias("text")) for kind, df in frames.items()))


_Q = """said AS (SELECT conv_id, turn, lower(text) || CASE conv_id % 6 WHEN 0 THEN ' top risk' WHEN 1 THEN ' path between' WHEN 2 THEN ' who is it' WHEN 3 THEN ' audit of a bill' WHEN 4 THEN ' net worth and donation' ELSE '' END AS q FROM conversations)"""


@query(oracle("""SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'connect|path|link|between|relationship|donate|alliance|ally') THEN 'relationship_query' WHEN regexp_matches(q, 'top|most|highest|risk|flag|hhi|concentration|bid|pattern|campaign|donation|saln|wealth|blacklist|phoenix|subcontract|circular|shell') THEN 'analytical'
 WHEN regexp_matches(q, 'who is|what is|tell me about|show me') THEN 'entity_lookup' ELSE 'open_ended' END AS intent,
 array_to_string(list_filter(['philgeps', CASE WHEN regexp_matches(q, 'audit|coa') THEN 'coa' END, CASE WHEN regexp_matches(q, 'saln|net worth|wealth declaration') THEN 'ombudsman' END, CASE WHEN regexp_matches(q, 'campaign|donation|soce') THEN 'comelec' END, CASE WHEN contains(q, 'blacklist') THEN 'gppb' END, CASE WHEN regexp_matches(q, 'bill|congress|legislat') THEN 'congress' END], lambda x: x IS NOT NULL), ',') AS sources FROM said""", _Q))
def question_intents(d: Domain):
    """Intent and sources of a question by its words; the invented texts get a few real ones."""
    k = F.col("conv_id") % 6
    more = F.when(k == 0, " top risk").when(k == 1, " path between").when(k == 2, " who is it").when(k == 3, " audit of a bill").when(k == 4, " net worth and donation").otherwise("")
    said = d.table("conversations").select("conv_id", "turn", F.concat("text", more).alias("q"))
    return said.select("conv_id", "turn", fn.intent(F.col("q")).alias("intent"), F.array_join(fn.answer_sources(F.col("q")), ",").alias("sources"))


@query(oracle("""SELECT id, CASE kind WHEN 'office' THEN 'entity' WHEN 'person' THEN 'person' ELSE CASE k WHEN 0 THEN 'alleged' WHEN 1 THEN 'action' WHEN 2 THEN 'action' WHEN 3 THEN 'news' ELSE 'normal' END END AS status FROM (SELECT 'F' || firm AS id, 'firm' AS kind, firm % 6 AS k FROM firms UNION ALL SELECT 'O-' || office, 'office', 0 FROM places UNION ALL SELECT 'P' || person, 'person', 0 FROM officials)"""))
def node_tiers(d: Domain):
    """Display tier of every node: office, person, alleged, action, news, normal."""
    k = F.col("firm") % 6
    actions = F.when(k == 0, F.array(F.lit("blacklisted"), F.lit("charged_pending"))).when(k == 1, F.array(F.lit("sec_cancelled"))).otherwise(F.array(F.lit("cleared")))
    firms = d.firms.select(F.concat(F.lit("F"), "firm").alias("id"), F.lit("Contractor").alias("kind"), actions.alias("actions"), (k == 2).alias("revoked"), (k == 3).alias("in_news"))
    others = d.places.select(F.concat(F.lit("O-"), "office").alias("id"), F.lit("ProcuringEntity").alias("kind")).unionByName(d.officials.select(F.concat(F.lit("P"), "person").alias("id"), F.lit("Person").alias("kind")))
    return firms.unionByName(others, allowMissingColumns=True).select("id", fn.tier(F.col("kind"), F.col("actions"), F.col("revoked"), F.col("in_news")).alias("status"))


@query(oracle("""SELECT 'Contract' AS entity, 'reference_number' AS field, count(*) AS total, 0::BIGINT AS missing, 'PASS' AS status FROM contracts UNION ALL SELECT 'Contract', 'procuring_entity', count(*), count(*) FILTER (ref % 20 = 0), CASE WHEN count(*) FILTER (ref % 20 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END FROM contracts
 UNION ALL SELECT 'Contractor', 'name', count(*), 0, 'PASS' FROM firms UNION ALL SELECT 'Agency', 'name', count(*), 0, 'PASS' FROM places UNION ALL SELECT 'Politician', 'name', count(*), 0, 'PASS' FROM officials UNION ALL SELECT 'Politician', 'position', count(*), 0, 'PASS' FROM officials
 UNION ALL SELECT 'Municipality', 'psgc_code', count(*), 0, 'PASS' FROM places UNION ALL SELECT 'Municipality', 'name', count(*), 0, 'PASS' FROM places"""))
def required_fields(d: Domain):
    """Completeness of every required field of five kinds of node."""
    contract = d.contracts.select(F.col("ref").alias("reference_number"), F.when(F.col("ref") % 20 != 0, F.col("office")).otherwise("").alias("procuring_entity"))
    place = d.places.select(F.col("nation_key").alias("psgc_code"), F.col("office").alias("name"))
    return quality.completeness({"Contract": (contract, ["reference_number", "procuring_entity"]), "Contractor": (d.firms, ["name"]), "Agency": (place, ["name"]), "Politician": (d.officials.withColumnRenamed("surname", "name"), ["name", "position"]), "Municipality": (place, ["psgc_code", "name"])})


@query(oracle("""SELECT 'R' || lpad(CAST(s_suppkey % 500 AS VARCHAR), 4, '0') AS psgc_code, s_name AS name, p.name AS province, r.name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT n_nationkey AS k, n_name AS name FROM nation) p ON p.k = s_nationkey LEFT JOIN (SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey <> 0) r ON r.k = n_regionkey"""))
def enriched_places(d: Domain):
    """Places with the names of their province and region by code; unknown codes give null."""
    regions = d.table("region").where("r_regionkey <> 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    provinces = d.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("province"), "n_regionkey")
    rows = d.table("supplier").join(provinces, "s_nationkey").join(regions, "n_regionkey", "left")
    return rows.select(F.concat(F.lit("R"), F.lpad((F.col("s_suppkey") % 500).cast("string"), 4, "0")).alias("psgc_code"), F.col("s_name").alias("name"), "province", "region")


@query(oracle("""SELECT 'bill' AS kind, 'B' || ref AS id, CASE WHEN ref % 2 = 0 THEN 'Act on ' || category ELSE 'Long title ' || ref END AS title, strftime(award_date, '%Y-%m-%d') AS dated FROM contracts UNION ALL SELECT 'committee', office, CASE WHEN nation_key % 2 = 0 THEN 'Chair ' || nation_key ELSE 'Chairman ' || nation_key END, NULL FROM places"""))
def bills_and_committees(d: Domain):
    """Bills and committees under one of two header names each."""
    raw = d.contracts.select(F.when(F.col("ref") % 3 == 0, F.concat(F.lit("B"), "ref")).alias("number"), F.concat(F.lit("B"), "ref").alias("bill_number"), F.when(F.col("ref") % 2 == 0, F.concat(F.lit("Act on "), "category")).alias("title"), F.concat(F.lit("Long title "), "ref").alias("long_title"), F.lit(None).cast("string").alias("filed_date"), F.date_format("award_date", "yyyy-MM-dd").alias("date_filed"))
    bills = raw.select(F.lit("bill").alias("kind"), F.coalesce("number", "bill_number").alias("id"), F.coalesce("title", "long_title").alias("title"), F.coalesce("filed_date", "date_filed").alias("dated"))
    chairs = d.places.select(F.col("office").alias("id"), F.when(F.col("nation_key") % 2 == 0, F.concat(F.lit("Chair "), "nation_key")).alias("chair"), F.concat(F.lit("Chairman "), "nation_key").alias("chairman"))
    return bills.unionByName(chairs.select(F.lit("committee").alias("kind"), "id", F.coalesce("chair", "chairman").alias("title"), F.lit(None).cast("string").alias("dated")))
