"""Quality checks, families in office, and look-ups on the mapped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators import dynasties, quality
from awardlens.operators.flags import phoenix_links
from awardlens.plans.flags import DIR, DON, donations
from awardlens.plans.network import PAIRS, focus_pairs
from awardlens.plans.registry import registry
from awardlens.sources.tables import FOCUS, Domain, oracle

QUERIES, ORACLES, query = registry()


@query(oracle("""SELECT entity, field, total, missing, CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
 SELECT 'contract' AS entity, 'office' AS field, count(*) AS total, count(*) FILTER (office IS NULL OR office = '') AS missing FROM contracts UNION ALL SELECT 'contract', 'amount', count(*), count(*) FILTER (amount IS NULL) FROM contracts
 UNION ALL SELECT 'contract', 'award_date', count(*), count(*) FILTER (award_date IS NULL) FROM contracts UNION ALL SELECT 'firm', 'name', count(*), count(*) FILTER (name IS NULL OR name = '') FROM firms
 UNION ALL SELECT 'official', 'term_start', count(*), count(*) FILTER (term_start IS NULL) FROM officials)"""))
def quality_completeness(d: Domain):
    return quality.completeness({"contract": (d.contracts, ["office", "amount", "award_date"]), "firm": (d.firms, ["name"]), "official": (d.officials, ["term_start"])})


@query(oracle("""SELECT 'AWARDED_TO' AS type, (SELECT count(*) FROM winners WHERE ref NOT IN (SELECT ref FROM contracts WHERE ref % 7 <> 0)) AS no_source, (SELECT count(*) FROM winners WHERE firm NOT IN (SELECT firm FROM firms WHERE firm % 9 <> 0)) AS no_target
 UNION ALL SELECT 'PROCURED', 0, (SELECT count(*) FROM contracts WHERE ref % 7 = 0)"""))
def quality_integrity(d: Domain):
    """Dangling edges after some contracts and firms were left out."""
    contracts = d.contracts.where("ref % 7 <> 0").select(F.col("ref").alias("id"))
    firms = d.firms.where("firm % 9 <> 0").select(F.col("firm").alias("id"))
    won = d.winners.select(F.col("ref").alias("src"), F.col("firm").alias("dst"))
    procured = d.contracts.select(F.col("office").alias("src"), F.col("ref").alias("dst"))
    return quality.integrity({"AWARDED_TO": (won, contracts, firms), "PROCURED": (procured, d.places.select(F.col("office").alias("id")), contracts)})


@query(oracle("""SELECT 'part' AS entity, count(*) AS groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS members FROM (SELECT count(*) AS c FROM part GROUP BY upper(p_type) HAVING count(*) > 1) UNION ALL SELECT 'firm', count(*), CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM firms GROUP BY upper(name) HAVING count(*) > 1)"""))
def quality_duplicates(d: Domain):
    return quality.duplicates({"part": (d.table("part"), "p_type"), "firm": (d.firms, "name")})


@query(oracle("""SELECT category, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN ref END, ',' ORDER BY ref) AS sample_refs FROM (SELECT c.category, ref, row_number() OVER (PARTITION BY c.category ORDER BY ref) AS k FROM contracts c JOIN
 (SELECT category, avg(CAST(amount AS DOUBLE)) AS m, stddev_samp(CAST(amount AS DOUBLE)) AS s FROM contracts WHERE amount > 0 GROUP BY 1) t ON c.category = t.category WHERE CAST(amount AS DOUBLE) > m + 1.7 * s) GROUP BY 1"""))
def quality_outliers(d: Domain):
    """Amounts over mean + 1.7 deviations of their category (uniform amounts have none over three)."""
    return quality.outliers(d.contracts, "amount", "category", 1.7)


@query(oracle("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) FILTER (office IS NULL) AS missing FROM contracts UNION ALL SELECT count(*) FILTER (amount IS NULL) FROM contracts
 UNION ALL SELECT count(*) FILTER (award_date IS NULL) FROM contracts UNION ALL SELECT count(*) FILTER (name IS NULL) FROM firms UNION ALL SELECT count(*) FILTER (term_start IS NULL) FROM officials)) GROUP BY 1"""))
def quality_summary(d: Domain):
    return quality_completeness(d).groupBy("status").agg(F.count("*").alias("n"))


_FAM = """SELECT surname, province, member_count, positions, earliest_term, latest_term, duration_years, round(least(100.0, 10.0 * member_count + 5.0 * n_positions + 2.0 * coalesce(duration_years, 0)), 4) AS dynasty_score, CASE WHEN o = 1 THEN 'fat' ELSE 'thin' END AS dynasty_type FROM
 (SELECT surname, province, count(*) AS member_count, string_agg(DISTINCT position, ',' ORDER BY position) AS positions, count(DISTINCT position) AS n_positions, min(term_start) AS earliest_term, max(term_end) AS latest_term,
 round(date_diff('day', min(term_start), max(term_end)) / 365.25, 4) AS duration_years, coalesce(max(CASE WHEN EXISTS (SELECT 1 FROM officials q WHERE q.surname = p.surname AND q.province = p.province AND q.person <> p.person AND q.term_start <= p.term_end AND q.term_end >= p.term_start) THEN 1 ELSE 0 END), 0) AS o
 FROM officials p GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(oracle(_FAM))
def dynasties_found(d: Domain):
    return dynasties.families(d.officials)


@query(oracle(f"""SELECT kind, n, round(val, 2) AS val, round(100 * val / sum(val) OVER (), 4) AS share_pct FROM (SELECT CASE WHEN firm IN (SELECT f.firm FROM firms f JOIN officials p ON p.person = f.firm * 3 JOIN ({_FAM}) z ON z.surname = p.surname AND z.province = p.province) THEN 'dynasty' ELSE 'independent' END AS kind, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS val FROM awards GROUP BY 1)"""))
def dynasty_vs_independent(d: Domain):
    """Value of firms owned by a member of a family in office, against the others."""
    members = d.officials.join(dynasties.families(d.officials).select("surname", "province"), ["surname", "province"], "left_semi")
    tied = d.firms.select("firm", (F.col("firm") * 3).alias("person")).join(members.select("person"), "person", "left_semi")
    return dynasties.captured_value(d.awards, tied)


@query(oracle("""SELECT f.firm, p.person, p.surname, home, province, home = province AS same_place FROM firms f JOIN officials p ON p.person = f.firm * 3"""))
def ownership_links(d: Domain):
    """Officials who own firms, and whether firm and office share a place."""
    return d.firms.withColumn("person", F.col("firm") * 3).join(d.officials, "person").select("firm", "person", "surname", "home", "province", (F.col("home") == F.col("province")).alias("same_place"))


@query(oracle("""SELECT surname, province, count(*) AS n, CAST(sum(net_worth) AS DOUBLE) AS worth FROM officials GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY worth DESC, surname, province LIMIT 20"""))
def wealth_ranking(d: Domain):
    sums = d.officials.groupBy("surname", "province").agg(F.count("*").alias("n"), F.sum("net_worth").cast("double").alias("worth"))
    return sums.where("n >= 2").orderBy(F.desc("worth"), "surname", "province").limit(20)


@query(oracle("""SELECT person, first_year, last_year, CAST(first_worth AS DOUBLE) AS first_worth, CAST(last_worth AS DOUBLE) AS last_worth, round(CASE WHEN first_worth <> 0 THEN 100.0 * CAST(last_worth - first_worth AS DOUBLE) / CAST(first_worth AS DOUBLE) END, 4) AS growth_pct FROM
 (SELECT customer AS person, min(year) AS first_year, max(year) AS last_year, min_by(v, year) AS first_worth, max_by(v, year) AS last_worth FROM (SELECT customer, year, sum(amount) AS v FROM contracts GROUP BY 1, 2) GROUP BY 1)"""))
def wealth_growth(d: Domain):
    """Declared wealth (a customer's yearly orders) from the first to the last year."""
    yearly = d.contracts.groupBy(F.col("customer").alias("person"), "year").agg(F.sum("amount").alias("v"))
    ends = yearly.groupBy("person").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("v", "year").cast("double").alias("first_worth"), F.max_by("v", "year").cast("double").alias("last_worth"))
    return ends.withColumn("growth_pct", F.round(F.when(F.col("first_worth") != 0, 100.0 * (F.col("last_worth") - F.col("first_worth")) / F.col("first_worth")), 4))


@query(oracle("""SELECT 'contract' AS kind, count(*) AS n FROM contracts UNION ALL SELECT 'firm', count(*) FROM firms UNION ALL SELECT 'office', count(*) FROM places UNION ALL SELECT 'official', count(*) FROM officials UNION ALL SELECT 'audit', 0
 UNION ALL SELECT 'AWARDED_TO', count(*) FROM winners UNION ALL SELECT 'BID_ON', count(*) FROM bids UNION ALL SELECT 'DONATED_TO', count(*) FROM don""", DON))
def graph_stats(d: Domain):
    """Nodes and edges by kind, kinds without any included."""
    frames = {"contract": d.contracts, "firm": d.firms, "office": d.places, "official": d.officials, "AWARDED_TO": d.winners, "BID_ON": d.bids, "DONATED_TO": donations(d)}
    counted = None
    for kind, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        counted = one if counted is None else counted.unionByName(one)
    kinds = d.spark.createDataFrame([(k,) for k in [*frames, "audit"]], "kind string")
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query(oracle("""SELECT f.firm, name, coalesce(n_wins, 0) AS n_wins, coalesce(val, 0) AS val, coalesce(n_bids, 0) AS n_bids, round(CASE WHEN n_bids > 0 THEN least_wins / n_bids ELSE 0 END, 6) AS win_rate, coalesce(n_offices, 0) AS n_offices FROM firms f
 LEFT JOIN (SELECT firm, count(*) AS n_wins, CAST(sum(amount) AS DOUBLE) AS val, count(DISTINCT office) AS n_offices FROM awards GROUP BY 1) a ON f.firm = a.firm LEFT JOIN (SELECT firm, count(*) AS n_bids FROM bids GROUP BY 1) b ON f.firm = b.firm
 LEFT JOIN (SELECT w AS firm, count(*) AS least_wins FROM (SELECT min_by(firm, (bid, firm)) AS w FROM bids GROUP BY ref) GROUP BY 1) l ON f.firm = l.firm"""))
def contractor_profile(d: Domain):
    """Wins, value, bids, the share of bids that were the lowest, and offices of every firm."""
    wins = d.awards.groupBy("firm").agg(F.count("*").alias("n_wins"), F.sum("amount").cast("double").alias("val"), F.count_distinct("office").alias("n_offices"))
    offered = d.bids.groupBy("firm").agg(F.count("*").alias("n_bids"))
    lowest = d.bids.groupBy("ref").agg(F.min_by("firm", F.struct("bid", "firm")).alias("firm")).groupBy("firm").agg(F.count("*").alias("lowest"))
    joined = d.firms.select("firm", "name").join(wins, "firm", "left").join(offered, "firm", "left").join(lowest, "firm", "left")
    rate = F.round(F.when(F.col("n_bids") > 0, F.col("lowest") / F.col("n_bids")).otherwise(0.0), 6)
    return joined.select("firm", "name", F.coalesce("n_wins", F.lit(0)).alias("n_wins"), F.coalesce("val", F.lit(0.0)).alias("val"), F.coalesce("n_bids", F.lit(0)).alias("n_bids"), rate.alias("win_rate"), F.coalesce("n_offices", F.lit(0)).alias("n_offices"))


@query(oracle("SELECT dst AS id, weight FROM (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs) WHERE src = (SELECT min(src) FROM pairs) ORDER BY id LIMIT 10 OFFSET 5", PAIRS))
def neighbors_page(d: Domain, page: int = 10, skip: int = 5):
    """One page of a firm's neighbours in id order."""
    e = focus_pairs(d).select("src", "dst", "weight")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    seed = F.broadcast(e.agg(F.min("src").alias("seed")))
    return both.join(seed, F.col("src") == F.col("seed"), "left_semi").select(F.col("dst").alias("id"), "weight").orderBy("id").offset(skip).limit(page)


@query(oracle("SELECT src, dst, weight FROM pairs WHERE src IN (SELECT * FROM ids) AND dst IN (SELECT * FROM ids)", PAIRS + ", ids AS (SELECT DISTINCT src AS id FROM und ORDER BY id LIMIT 30)"))
def overview(d: Domain, nodes: int = 30):
    """The first nodes by id and the edges among them."""
    e = focus_pairs(d).select("src", "dst", "weight")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().orderBy("id").limit(nodes)
    small = F.broadcast(ids)
    return e.join(small.withColumnRenamed("id", "src"), "src", "left_semi").join(small.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


@query(oracle("SELECT ref, firm, CAST(amount AS DOUBLE) AS amount, award_date FROM awards WHERE office = (SELECT min(office) FROM places) ORDER BY amount DESC, ref, firm LIMIT 15"))
def entity_contracts(d: Domain, n: int = 15):
    """The first office's largest awards."""
    seed = F.broadcast(d.places.agg(F.min("office").alias("office")))
    return d.awards.join(seed, "office", "left_semi").select("ref", "firm", F.col("amount").cast("double").alias("amount"), "award_date").orderBy(F.desc("amount"), "ref", "firm").limit(n)


@query(oracle("SELECT firm, name, home, home_region, CAST(capital AS DOUBLE) AS capital FROM firms WHERE firm = 7"))
def node_by_id(d: Domain, firm: int = 7):
    return d.firms.where(F.col("firm") == firm).select("firm", "name", "home", "home_region", F.col("capital").cast("double").alias("capital"))


@query(oracle("""SELECT person, firm, office, ref, CAST(amount AS DOUBLE) AS amount, award_date FROM (SELECT DISTINCT person, firm, office FROM don) JOIN awards USING (firm, office) WHERE person = (SELECT min(person) FROM don) ORDER BY award_date DESC, ref, firm LIMIT 100""", DON))
def campaign_contracts(d: Domain, n: int = 100):
    """The latest contracts that a person's donations lead to: same firm, same office."""
    given = donations(d).select("person", "firm", "office").distinct()
    seed = F.broadcast(given.agg(F.min("person").alias("person")))
    rows = given.join(seed, "person", "left_semi").join(d.awards, ["firm", "office"])
    return rows.select("person", "firm", "office", "ref", F.col("amount").cast("double").alias("amount"), "award_date").orderBy(F.desc("award_date"), "ref", "firm").limit(n)


@query(oracle("""SELECT a AS firm, b AS listed, string_agg(DISTINCT via, ',' ORDER BY via) AS via FROM (SELECT a, b, 'address' AS via FROM addr UNION ALL SELECT b, a, 'address' FROM addr UNION ALL SELECT a, b, 'director' FROM dirs UNION ALL SELECT b, a, 'director' FROM dirs)
 WHERE b IN (SELECT firm FROM firms WHERE capital < 0) AND a NOT IN (SELECT firm FROM firms WHERE capital < 0) GROUP BY 1, 2""", DIR))
def phoenix_companies(d: Domain):
    """Unlisted firms that share an address or a director with a blacklisted one."""
    listed = d.firms.where("capital < 0")
    shared = {"address": F.concat_ws("-", "home", (F.col("firm") % 7).cast("string")), "director": (F.col("firm") % 30).cast("string")}
    parts = [phoenix_links(d.firms.select(key.alias("key"), "firm"), "key", listed).withColumn("via", F.lit(via)) for via, key in shared.items()]
    found = parts[0].unionByName(parts[1])
    return found.groupBy(F.col("a").alias("firm"), F.col("b").alias("listed")).agg(F.array_join(F.sort_array(F.collect_set("via")), ",").alias("via"))


@query(oracle("""SELECT event_type AS finding, severity, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS val FROM (SELECT *, CASE WHEN contains(event_type, 'purchase') THEN 'high' WHEN contains(event_type, 'click') THEN 'medium' ELSE 'low' END AS severity FROM events) WHERE severity <> 'low' GROUP BY 1, 2"""))
def audit_keyword_findings(d: Domain):
    """Findings by keyword with a severity; event types stand for finding texts."""
    kind = F.when(F.col("event_type").contains("purchase"), "high").when(F.col("event_type").contains("click"), "medium").otherwise("low")
    rows = d.table("events").select(F.col("event_type").alias("finding"), kind.alias("severity"), F.col("value").cast("decimal(18,2)").alias("v")).where("severity <> 'low'")
    return rows.groupBy("finding", "severity").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("val"))


@query(oracle("""SELECT p.surname, p.province, count(*) AS n_findings, count(DISTINCT p.person) AS n_members FROM events e JOIN officials p ON e.user_id = p.person JOIN (SELECT surname, province FROM officials GROUP BY 1, 2 HAVING count(*) >= 2) f ON f.surname = p.surname AND f.province = p.province WHERE e.event_type = 'purchase' GROUP BY 1, 2"""))
def audit_of_dynasties(d: Domain):
    """Findings against members of families in office."""
    kin = d.officials.join(dynasties.families(d.officials).select("surname", "province"), ["surname", "province"], "left_semi").select("person", "surname", "province")
    rows = d.table("events").where("event_type = 'purchase'").select(F.col("user_id").alias("person")).join(kin, "person")
    return rows.groupBy("surname", "province").agg(F.count("*").alias("n_findings"), F.count_distinct("person").alias("n_members"))


@query(oracle("""SELECT kind, id, label FROM (SELECT 'firm' AS kind, 'F' || firm AS id, name AS label FROM firms UNION ALL SELECT 'part', 'P' || p_partkey, p_name FROM part) WHERE list_contains(list_transform(string_split(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: starts_with(w, '0000000')), true) ORDER BY kind, id LIMIT 20"""))
def fulltext_search(d: Domain, prefix: str = "0000000", n: int = 20):
    """Entities with a word that starts with a term; the kind filter comes before the limit."""
    from awardlens.functions.text import search_form

    firms = d.firms.select(F.lit("firm").alias("kind"), F.concat(F.lit("F"), "firm").alias("id"), F.col("name").alias("label"))
    parts = d.table("part").select(F.lit("part").alias("kind"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    hit = F.exists(F.split(search_form(F.col("label")), " "), lambda w: w.startswith(prefix))
    return firms.unionByName(parts).where(hit).orderBy("kind", "id").limit(n)


@query(oracle("""SELECT ref, office, year, string_agg(firm, ' ' ORDER BY firm) AS firms FROM focus GROUP BY 1, 2, 3"""))
def node_load_rows(d: Domain):
    """Contract nodes with their firms, as a loader writes them."""
    rows = d.focus.groupBy("ref", "office", "year").agg(F.sort_array(F.collect_set("firm")).alias("f"))
    return rows.select("ref", "office", "year", F.array_join("f", " ").alias("firms"))


@query(oracle("""SELECT region, province, count(*) OVER w AS n, CAST(sum(v) OVER w AS DOUBLE) AS val, CAST(row_number() OVER (PARTITION BY region, province ORDER BY name) AS INT) AS place, name FROM
 (SELECT home_region AS region, home AS province, name, v FROM firms JOIN (SELECT firm, sum(amount) AS v FROM awards WHERE category = '1-URGENT' GROUP BY 1) USING (firm)) WINDOW w AS (PARTITION BY region, province)"""))
def registry_layer(d: Domain):
    """Registered firms by place, a row each, with the number and focus value of the place's firms."""
    sums = d.awards.where(F.col("category") == FOCUS).groupBy("firm").agg(F.sum("amount").alias("v"))
    rows = d.firms.join(sums, "firm").select(F.col("home_region").alias("region"), F.col("home").alias("province"), "name", "v")
    totals = rows.groupBy("region", "province").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("val"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("region", "province").orderBy("name")))
    return placed.join(totals, ["region", "province"]).select("region", "province", "n", "val", "place", "name")


@query(oracle("""SELECT home, away, n, round(n / sum(n) OVER (PARTITION BY home), 6) AS share FROM (SELECT home_region AS home, region AS away, count(*) AS n FROM awards JOIN firms USING (firm) GROUP BY 1, 2)"""))
def home_and_away(d: Domain):
    """Awards by the firm's home region and the contract's region."""
    rows = d.awards.join(d.firms.select("firm", "home_region"), "firm").groupBy(F.col("home_region").alias("home"), F.col("region").alias("away")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("home")), 6))


@query(oracle("""SELECT persons.pid, source_label, CAST(day AS VARCHAR) AS day, left(label, 60) AS label FROM (SELECT person AS pid, firm, min(ref) AS r FROM (SELECT customer AS person, firm, ref FROM focus) GROUP BY 1, 2) persons JOIN (SELECT ref, award_date AS day, office AS source_label, category || ' ' || office || ' ' || region AS label FROM contracts) s ON s.ref = persons.r"""))
def hetero_edges(d: Domain):
    """Dated person-firm edges: the date is that of the first source."""
    first = d.focus.groupBy(F.col("customer").alias("pid"), "firm").agg(F.min("ref").alias("ref"))
    s = d.contracts.select("ref", F.date_format("award_date", "yyyy-MM-dd").alias("day"), F.col("office").alias("source_label"), F.concat_ws(" ", "category", "office", "region").alias("label"))
    return first.join(s, "ref").select("pid", "source_label", "day", F.left("label", F.lit(60)).alias("label"))


def inventory(d: Domain) -> DataFrame:
    """Files and rows of the contract table."""
    return quality.inventory(d.table("orders")).select("file", "n")


QUERIES["pipeline_inventory"] = lambda spark, sf_dir: inventory(Domain(spark, sf_dir))
ORACLES["pipeline_inventory"] = "SELECT 'orders.parquet' AS file, count(*) AS n FROM orders"
