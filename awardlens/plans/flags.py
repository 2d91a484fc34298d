"""Red-flag queries over the mapped tables, and scores over all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators import flags as op
from awardlens.operators import rollups, sheets
from awardlens.plans.registry import registry
from awardlens.sources.tables import FOCUS, MONEY, Domain, oracle

QUERIES, ORACLES, query = registry()
THRESHOLD = 250_000

_OUT = "'{flag}' AS flag, '{severity}' AS severity, '{kind}' AS entity_type, CAST({entity} AS VARCHAR) AS entity_id, CAST({n} AS BIGINT) AS n, round(CAST({val} AS DOUBLE), 2) AS val"


def _sql(flag, severity, kind, entity, n, val, rest):
    return "SELECT " + _OUT.format(flag=flag, severity=severity, kind=kind, entity=entity, n=n, val=val) + " " + rest


def addresses(d: Domain) -> DataFrame:
    """firm, address: one of seven streets of the firm's nation."""
    return d.firms.select("firm", F.concat_ws("-", "home", (F.col("firm") % 7).cast("string")).alias("address"))


def directors(d: Domain) -> DataFrame:
    """firm, director: firms numbered alike modulo 30 share one."""
    return d.firms.select("firm", (F.col("firm") % 30).alias("director"))


def subcontracts(d: Domain) -> DataFrame:
    """Directed edges from a focus contract's firm of the largest bid to that of the smallest one, summed over contracts."""
    chosen = d.contracts.where("category = '1-URGENT'").select("ref")
    order = F.struct("bid", "firm")
    ends = d.bids.join(chosen, "ref", "left_semi").groupBy("ref").agg(F.max_by("firm", order).alias("src"), F.min_by("firm", order).alias("dst"), F.min("bid").alias("amount"))
    return ends.where("src <> dst").groupBy("src", "dst").agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n"))


def donations(d: Domain) -> DataFrame:
    """Purchases by the firm of the customer's number modulo the firms, to the customer's office."""
    e = d.table("events").where("event_type = 'purchase'").select(F.col("user_id").alias("person"), F.col("value").cast("decimal(18,2)").alias("given"))
    person = d.officials.select("person", F.col("province").alias("office"))
    return e.join(person, "person").select((F.col("person") % 10 + 1).alias("firm"), "office", "given", "person")


SUB = """sub AS (SELECT src, dst, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM (SELECT ref, arg_max(firm, (bid, firm)) AS src, arg_min(firm, (bid, firm)) AS dst, min(bid) AS amount
  FROM bids SEMI JOIN (SELECT ref FROM contracts WHERE category = '1-URGENT') USING (ref) GROUP BY ref) WHERE src <> dst GROUP BY 1, 2)"""
DON = """don AS (SELECT person % 10 + 1 AS firm, province AS office, CAST(value AS DECIMAL(18,2)) AS given, person FROM events JOIN officials ON user_id = person WHERE event_type = 'purchase')"""
DIR = """dirs AS (SELECT x.firm AS a, y.firm AS b FROM firms x JOIN firms y ON x.firm % 30 = y.firm % 30 AND x.firm < y.firm),
addr AS (SELECT x.firm AS a, y.firm AS b FROM firms x JOIN firms y ON x.home = y.home AND x.firm % 7 = y.firm % 7 AND x.firm < y.firm)"""
HHI = "SELECT office, round(10000.0 * sum(v * v) / (sum(v) * sum(v)), 4) AS hhi, count(*) AS n_firms, round(sum(v), 2) AS val FROM (SELECT office, firm, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1, 2) GROUP BY office"

BODIES = {
    "flag_single_bidder": _sql("single_bidder", "medium", "firm", "firm", "count(*)", "sum(amount)", "FROM (SELECT ref, min(firm) AS firm FROM bids GROUP BY 1 HAVING count(*) = 1) JOIN contracts USING (ref) GROUP BY firm HAVING count(*) >= 3"),
    "flag_identical_bids": _sql("identical_bids", "high", "firm", "x.firm", "y.firm", "x.bid", "FROM bids x JOIN bids y ON x.ref = y.ref AND x.firm < y.firm WHERE x.bid > 0 AND y.bid > 0 AND CAST(abs(x.bid - y.bid) AS DOUBLE) < CAST(x.bid AS DOUBLE) * 0.001"),
    "flag_split": _sql("split_contracts", "high", "firm", "firm", "count(*)", "sum(amount)", "FROM awards WHERE amount > 175000 AND amount < 250000 GROUP BY office, firm HAVING count(*) >= 3"),
    "flag_concentration": _sql("concentration", "high", "office", "office", "n_firms", "val", f"FROM ({HHI}) WHERE hhi > 130"),
    "flag_rotating": _sql("rotating_winners", "high", "firm", "a", "k", "wa + wb", """FROM (SELECT x.firm AS a, y.firm AS b, count(*) AS k, count(*) FILTER (w = x.firm) AS wa, count(*) FILTER (w = y.firm) AS wb
 FROM bids x JOIN bids y ON x.ref = y.ref AND x.firm < y.firm LEFT JOIN (SELECT ref, min_by(firm, (bid, firm)) AS w FROM bids GROUP BY 1) v ON x.ref = v.ref GROUP BY 1, 2) WHERE k >= 3 AND wa > 0 AND wb > 0"""),
    "flag_political": _sql("political_connection", "high", "firm", "firm", "count(DISTINCT o.person)", "0", "FROM firms JOIN officials p ON p.person = firm * 3 JOIN officials o ON o.surname = p.surname AND o.province = p.province AND o.person <> p.person GROUP BY firm"),
    "flag_geographic": _sql("geographic_anomaly", "medium", "firm", "firm", "count(*)", "sum(amount)", "FROM awards JOIN firms USING (firm) WHERE region <> home_region GROUP BY firm HAVING count(*) >= 3"),
    "flag_shell_company": _sql("shell_company", "high", "firm", "firm", "n", "v", "FROM (SELECT firm, count(*) AS n, sum(amount) AS v FROM awards GROUP BY 1) JOIN firms USING (firm) WHERE capital > 0 AND CAST(v AS DOUBLE) / CAST(capital AS DOUBLE) > 100"),
    "flag_phoenix": _sql("phoenix", "high", "firm", "a", "count(DISTINCT b)", "0", "FROM (SELECT a, b FROM dirs UNION SELECT b, a FROM dirs) WHERE b IN (SELECT firm FROM firms WHERE capital < 0) AND a NOT IN (SELECT firm FROM firms WHERE capital < 0) GROUP BY a"),
    "flag_campaign": _sql("campaign_connection", "high", "firm", "g.firm", "n", "v", "FROM (SELECT DISTINCT firm, office FROM don) g JOIN (SELECT firm, office, count(*) AS n, sum(amount) AS v FROM awards GROUP BY 1, 2) w ON g.firm = w.firm AND g.office = w.office"),
    "flag_circular": _sql("circular_flow", "critical", "firm", "a", "count(*)", "min(h)", """FROM (SELECT x.src AS a, 2 AS h FROM sub x JOIN sub y ON x.dst = y.src AND y.dst = x.src
 UNION ALL SELECT x.src, 3 FROM sub x JOIN sub y ON x.dst = y.src JOIN sub z ON y.dst = z.src AND z.dst = x.src WHERE y.dst <> x.src) GROUP BY a"""),
    "flag_timing": _sql("timing_cluster", "high", "firm", "firm", "count(*)", "sum(amount)", """FROM (SELECT *, lag(award_date) OVER w AS p, lead(award_date) OVER w AS q FROM awards WINDOW w AS (PARTITION BY office, firm ORDER BY award_date, ref))
 WHERE date_diff('day', p, award_date) <= 2 OR date_diff('day', award_date, q) <= 2 GROUP BY office, firm HAVING count(*) >= 3"""),
    "flag_shell_network": _sql("shell_network", "high", "firm", "x.a", "x.b", "coalesce(s, 0)", "FROM addr x LEFT JOIN (SELECT a, b, count(*) AS s FROM dirs GROUP BY 1, 2) y ON x.a = y.a AND x.b = y.b"),
}
MORE = f"{SUB}, {DON}, {DIR}"
ALL = " UNION ALL ".join(f"SELECT * FROM ({b})" for b in BODIES.values())


@query(oracle(BODIES["flag_single_bidder"]))
def flag_single_bidder(d: Domain):
    return op.single_bidder(d.bids, d.contracts)


@query(oracle(BODIES["flag_identical_bids"]))
def flag_identical_bids(d: Domain):
    return op.identical_bids(d.bids)


@query(oracle(BODIES["flag_split"]))
def flag_split(d: Domain):
    return op.split_contracts(d.awards, THRESHOLD)


@query(oracle(BODIES["flag_concentration"]))
def flag_concentration(d: Domain):
    return op.concentrated_offices(rollups.hhi(d.focus, ["office"]), 130)


@query(oracle(BODIES["flag_rotating"]))
def flag_rotating(d: Domain):
    lowest = d.bids.groupBy("ref").agg(F.min_by("firm", F.struct("bid", "firm")).alias("winner"))
    return op.rotating_winners(d.bids, lowest)


@query(oracle(BODIES["flag_political"]))
def flag_political(d: Domain):
    owned = d.firms.select("firm", (F.col("firm") * 3).alias("person"))
    return op.political_connection(owned, d.officials.select("person", "surname", "province"))


@query(oracle(BODIES["flag_geographic"]))
def flag_geographic(d: Domain):
    return op.away_from_home(d.awards, d.firms)


@query(oracle(BODIES["flag_shell_company"]))
def flag_shell_company(d: Domain):
    return op.shell_company(d.awards, d.firms)


@query(oracle(BODIES["flag_phoenix"], MORE))
def flag_phoenix(d: Domain):
    return op.phoenix(directors(d), "director", d.firms.where("capital < 0"))


@query(oracle(BODIES["flag_campaign"], MORE))
def flag_campaign(d: Domain):
    return op.campaign_connection(donations(d), d.awards)


@query(oracle(BODIES["flag_circular"], MORE))
def flag_circular(d: Domain):
    return op.circular_flow(subcontracts(d))


@query(oracle(BODIES["flag_timing"]))
def flag_timing(d: Domain):
    return op.timing_cluster(d.awards)


@query(oracle(BODIES["flag_shell_network"], MORE))
def flag_shell_network(d: Domain):
    return op.shell_network(addresses(d), directors(d))


def all_flags(d: Domain) -> DataFrame:
    """The flags of all thirteen detectors from one table of contracts and one of firms at offices."""
    lines = d.table("lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_suppkey").alias("firm"), F.col("l_extendedprice").cast(MONEY).alias("bid"))
    book = sheets.bid_sheets(lines, d.contracts, d.tasks)
    held = sheets.holdings(book, d.firms, THRESHOLD, FOCUS)
    given = donations(d).select("firm", "office").distinct().join(held.select("firm", "office", "n", "v"), ["firm", "office"])
    campaign = op.flagged(given, "campaign_connection", "high", "firm", F.col("firm"), F.col("n"), F.col("v"))
    others = (flag_political(d), flag_phoenix(d), op.circular_flow(sheets.subcontract_edges(book, FOCUS)), flag_shell_network(d))
    return reduce(DataFrame.unionByName, (sheets.bid_flags(book, d.tasks), sheets.award_flags(held, 130), campaign, *others))


@query(oracle(f"""SELECT entity_type, entity_id, CAST(sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS BIGINT) AS risk_score,
 count(*) AS n_flags, count(DISTINCT flag) AS n_kinds FROM ({ALL}) GROUP BY 1, 2""", MORE))
def risk_scores(d: Domain):
    """Severity-weighted scores of every entity over all detectors."""
    return op.risk_scores(all_flags(d))


@query(oracle(f"""SELECT entity_type, entity_id, n_kinds FROM (SELECT entity_type, entity_id, count(DISTINCT flag) AS n_kinds FROM ({ALL}) WHERE severity = 'high' GROUP BY 1, 2) ORDER BY n_kinds DESC, entity_type, entity_id LIMIT 20""", MORE))
def risk_top_high(d: Domain):
    """The twenty entities with most kinds of flags of high severity."""
    flags = all_flags(d).where("severity = 'high'")
    return op.risk_scores(flags).select("entity_type", "entity_id", "n_kinds").orderBy(F.desc("n_kinds"), "entity_type", "entity_id").limit(20)


@query(oracle("""SELECT x.office, x.firm, x.ref AS ref_a, y.ref AS ref_b, CAST(abs(date_diff('day', x.award_date, y.award_date)) AS INT) AS days, CAST(x.amount + y.amount AS DOUBLE) AS combined
 FROM awards x JOIN awards y ON x.office = y.office AND x.firm = y.firm AND x.ref < y.ref
 WHERE x.amount BETWEEN 175000 AND 250000 AND y.amount BETWEEN 175000 AND 250000 AND abs(date_diff('day', x.award_date, y.award_date)) <= 30"""))
def splitting_pairs_30d(d: Domain):
    return op.splitting_pairs(d.awards, THRESHOLD)


@query(oracle("""SELECT x.office, x.ref AS anchor, count(*) AS n, CAST(sum(y.amount) AS DOUBLE) AS val FROM contracts x JOIN contracts y ON x.office = y.office
 WHERE x.amount >= 175000 AND x.amount < 250000 AND y.amount >= 175000 AND y.amount < 250000
 AND (y.award_date > x.award_date OR (y.award_date = x.award_date AND y.ref >= x.ref)) AND date_diff('day', x.award_date, y.award_date) <= 30
 AND y.amount BETWEEN x.amount * 0.5 AND x.amount * 2 GROUP BY 1, 2 HAVING count(*) >= 2"""))
def split_clusters(d: Domain):
    return op.split_clusters(d.contracts, THRESHOLD)


@query(oracle("""SELECT office, firm, ref, award_date, CAST(amount AS DOUBLE) AS amount, n, combined FROM near JOIN (SELECT office, firm, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS combined FROM near GROUP BY 1, 2 HAVING count(*) >= 2) USING (office, firm)""",
 "near AS (SELECT office, firm, ref, CASE WHEN ref % 10 <> 0 THEN award_date END AS award_date, amount FROM awards WHERE amount BETWEEN 175000 AND 250000)"))
def splitting_undated(d: Domain):
    """Awards near the threshold by office and firm, where every tenth contract has no date."""
    return op.splitting_undated(d.awards.withColumn("award_date", F.when(F.col("ref") % 10 != 0, F.col("award_date"))), THRESHOLD)


@query(oracle("""SELECT office, count(*) AS n, count(*) FILTER (CAST(floor(amount) AS BIGINT) % 500 = 0) AS n_round, round(100.0 * count(*) FILTER (CAST(floor(amount) AS BIGINT) % 500 = 0) / count(*), 4) AS pct
 FROM contracts WHERE amount > 100000 GROUP BY 1"""))
def round_amounts(d: Domain):
    return op.round_amounts(d.contracts, 100_000, 500)


@query(oracle("SELECT CAST(amount AS DOUBLE) AS amount, count(*) AS n, min(ref) AS first_ref FROM (SELECT floor(amount) AS amount, ref FROM contracts) WHERE amount > 100000 GROUP BY 1 HAVING count(*) >= 2"))
def identical_amounts(d: Domain):
    """Whole amounts that several contracts share."""
    return op.identical_amounts(d.contracts.withColumn("amount", F.floor("amount")), 100_000)


@query(oracle("""SELECT month, n, round(val, 2) AS val, val > 2.0 * (SELECT avg(val) FROM m) AS surge FROM m""", "m AS (SELECT strftime(award_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS val FROM contracts GROUP BY 1)"))
def month_timeline_surge(d: Domain):
    return op.monthly_surges(d.contracts)
