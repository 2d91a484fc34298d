"""Network queries: joint focus awards, subcontract chains, centralities and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.operators import graph as op
from awardlens.operators import blocks, growth, rollups, sets, trails
from awardlens.operators.settle import settled
from awardlens.plans.flags import SUB, subcontracts
from awardlens.plans.registry import registry
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()


def joint_pairs(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """src, dst, weight, year: pairs of firms on the same contracts, how many and since when; summed in so many tasks where given."""
    pairs = rollups.co_pairs(rows, carry=("year",))
    return (pairs.repartition(tasks, "a", "b") if tasks else pairs).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").cast("double").alias("weight"), F.min("year").alias("year"))


def focus_pairs(d: Domain) -> DataFrame:
    return joint_pairs(d.focus, d.tasks)


PAIRS = """pairs AS (SELECT x.firm AS src, y.firm AS dst, CAST(count(*) AS DOUBLE) AS weight, min(x.year) AS year FROM focus x JOIN focus y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2),
und AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs)"""
REACH = PAIRS + """, reach AS (SELECT src AS id, src AS r FROM und UNION SELECT reach.id, und.dst FROM reach JOIN und ON reach.r = und.src),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


@query(oracle("SELECT id, component FROM comp", REACH))
def jv_components(d: Domain):
    return op.components(focus_pairs(d))


@query(oracle("""SELECT component, n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM (SELECT component, count(*) AS n_nodes FROM comp GROUP BY 1)
 JOIN (SELECT component, count(*) AS n_edges FROM pairs JOIN comp ON src = id GROUP BY 1) USING (component)""", REACH))
def jv_groups(d: Domain):
    e = focus_pairs(d)
    return op.component_stats(e, op.components(e))


@query(oracle("""SELECT year, (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT id, min(r) AS c FROM reach z WHERE z.y = years.year GROUP BY 1) GROUP BY c)) AS giant,
 (SELECT count(DISTINCT id) FROM reach z WHERE z.y = years.year) AS n_firms FROM years""", PAIRS + """, years AS (SELECT DISTINCT year FROM pairs),
by_year AS (SELECT y.year AS y, src, dst FROM years y JOIN pairs p ON p.year <= y.year UNION ALL SELECT y.year, dst, src FROM years y JOIN pairs p ON p.year <= y.year),
reach AS (SELECT y, src AS id, src AS r FROM by_year UNION SELECT reach.y, reach.id, b.dst FROM reach JOIN by_year b ON reach.r = b.src AND reach.y = b.y)"""))
def jv_giant_by_year(d: Domain):
    """Firms and the largest component of the graph of all pairs up to each year, from a spanning forest by first year."""
    pairs = settled(focus_pairs(d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "year"), "joint-pairs")
    found = growth.replay(pairs).select("year", F.col("giant"), F.col("nodes").alias("n_firms"))
    return found.join(pairs.select("year").distinct(), "year", "left_semi")


@query(oracle("SELECT src AS id, count(*) AS degree FROM und GROUP BY 1", PAIRS))
def degree(d: Domain):
    return op.degree(focus_pairs(d))


@query(oracle("SELECT x.src AS a, x.dst AS b, y.dst AS c FROM pairs x JOIN pairs y ON x.dst = y.src JOIN pairs z ON z.src = x.src AND z.dst = y.dst", PAIRS))
def triads(d: Domain):
    return op.triangles(focus_pairs(d))


def _ranks(n: int) -> str:
    steps = ", ".join(f"r{k} AS (SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(sum(r.rank * m.share), 0) AS rank FROM nodes n LEFT JOIN move m ON m.dst = n.id LEFT JOIN r{k - 1} r ON r.id = m.src GROUP BY n.id)" for k in range(1, n + 1))
    return PAIRS + f""", w AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), nodes AS (SELECT DISTINCT src AS id FROM w),
 move AS (SELECT w.src, w.dst, w.weight / o AS share FROM w JOIN (SELECT src, sum(weight) AS o FROM w GROUP BY 1) t ON w.src = t.src),
 r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes), {steps}"""


@query(oracle("SELECT id, round(CAST(rank AS DOUBLE), 8) AS rank FROM r10", _ranks(10)))
def pagerank(d: Domain):
    return op.pagerank(focus_pairs(d), 10).select("id", F.round("rank", 8).alias("rank"))


def _between(depth: int) -> str:
    """Distances and numbers of shortest paths of all pairs, level by level."""
    seen = lambda k: " UNION ALL ".join(f"SELECT s, t FROM b{i}" for i in range(k))
    levels = ", ".join(f"b{k} AS MATERIALIZED (SELECT s, t, CAST({k} AS INT) AS d, n FROM (SELECT b.s, u.dst AS t, sum(b.n) AS n FROM b{k - 1} b JOIN und u ON u.src = b.t GROUP BY 1, 2) WHERE (s, t) NOT IN ({seen(k)}))" for k in range(1, depth + 1))
    return PAIRS + f""", nodes AS (SELECT DISTINCT src AS id FROM und), b0 AS MATERIALIZED (SELECT id AS s, id AS t, 0 AS d, CAST(1 AS DOUBLE) AS n FROM nodes), {levels},
 way AS MATERIALIZED ({" UNION ALL ".join(f"SELECT s, t, d, CAST(n AS DOUBLE) AS n FROM b{k}" for k in range(1, depth + 1))}),
 mid AS (SELECT x.t AS id, sum(x.n * y.n / z.n) AS b FROM way x JOIN way y ON x.t = y.s JOIN way z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d GROUP BY 1)"""


@query(oracle("SELECT id, round(coalesce(b, 0) / greatest(1, (SELECT (count(*) - 1) * (count(*) - 2) FROM nodes)), 9) AS betweenness FROM nodes LEFT JOIN mid USING (id)", _between(6)))
def betweenness(d: Domain):
    """From the first 600 nodes; the oracle counts all pairs up to six steps, which are all there are in tables of fewer firms."""
    return op.betweenness(focus_pairs(d))


@query(oracle("SELECT id, label FROM l5", PAIRS + ", w AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), l0 AS (SELECT DISTINCT src AS id, src AS label FROM w), "
 + ", ".join(f"l{k} AS (SELECT id, max_by(label, (v, -label)) AS label FROM (SELECT w.src AS id, l.label, sum(weight) AS v FROM w JOIN l{k - 1} l ON l.id = w.dst GROUP BY 1, 2) GROUP BY id)" for k in range(1, 6))))
def communities(d: Domain):
    """Label propagation on the weighted co-award graph."""
    return op.label_propagation(focus_pairs(d), 5)


@query(oracle("""SELECT round(inside / m - (SELECT sum(pow(k / (2 * m), 2)) FROM (SELECT label, sum(w) AS k FROM (SELECT ls AS label, weight AS w FROM placed UNION ALL SELECT ld, weight FROM placed) GROUP BY 1)), 6) AS modularity
 FROM (SELECT sum(weight) AS m, sum(CASE WHEN ls = ld THEN weight ELSE 0 END) AS inside FROM placed)""", PAIRS + ", w AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), l0 AS (SELECT DISTINCT src AS id, src AS label FROM w), "
 + ", ".join(f"l{k} AS (SELECT id, max_by(label, (v, -label)) AS label FROM (SELECT w.src AS id, l.label, sum(weight) AS v FROM w JOIN l{k - 1} l ON l.id = w.dst GROUP BY 1, 2) GROUP BY id)" for k in range(1, 6))
 + ", placed AS (SELECT x.label AS ls, y.label AS ld, weight FROM pairs JOIN l5 x ON x.id = src JOIN l5 y ON y.id = dst)"))
def community_modularity(d: Domain):
    """Of the communities of all joint focus awards."""
    e = settled(focus_pairs(d), "joint-pairs")
    return op.modularity(e, op.label_propagation(e, 5))


@query(oracle("""SELECT a, b, round(sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END), 6) AS score, count(*) AS n_common FROM
 (SELECT x.src AS a, y.src AS b, x.dst AS mid FROM und x JOIN und y ON x.dst = y.dst AND x.src < y.src WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.src = x.src AND p.dst = y.src))
 JOIN (SELECT dst AS mid, count(*) AS d FROM und GROUP BY 1) USING (mid) GROUP BY 1, 2""", PAIRS))
def adamic_adar(d: Domain):
    """Scores of pairs that share a partner and have no joint award yet."""
    return op.open_adamic_adar(settled(focus_pairs(d), "joint-pairs"), 6).withColumnRenamed("common", "n_common")


@query(oracle("SELECT id, min(d) AS dist FROM walk GROUP BY id", PAIRS + """, start AS (SELECT min(src) AS s FROM und),
walk AS (SELECT s AS id, 0 AS d FROM start UNION SELECT und.dst, walk.d + 1 FROM walk JOIN und ON walk.id = und.src WHERE walk.d < 3)"""))
def subgraph_depth(d: Domain):
    """Nodes within three steps of the smallest firm."""
    e = focus_pairs(d)
    start = e.agg(F.min(F.least("src", "dst"))).first()[0]
    return op.distances(e, start, 3)


@query(oracle("SELECT array_to_string(min(p), ',') AS path, CAST(len(min(p)) - 1 AS INT) AS hops FROM walk WHERE id = (SELECT t FROM ends) HAVING count(*) > 0", PAIRS + """, ends AS (SELECT min(src) AS s, max(src) AS t FROM und),
far AS (SELECT s AS id, 0 AS d FROM ends UNION SELECT und.dst, far.d + 1 FROM far JOIN und ON far.id = und.src WHERE far.d < 6), near AS (SELECT id, min(d) AS d FROM far GROUP BY id),
walk AS (SELECT s AS id, [s] AS p FROM ends UNION ALL SELECT und.dst, list_append(p, und.dst) FROM walk JOIN und ON walk.id = und.src JOIN near ON near.id = und.dst WHERE near.d = len(p) AND near.d <= (SELECT d FROM near, ends WHERE id = t))"""))
def shortest_path(d: Domain):
    """From the smallest to the largest firm of joint awards, within six steps."""
    e = focus_pairs(d)
    ends = op.undirected(e).agg(F.min("src").alias("s"), F.max("src").alias("t")).first()
    return op.shortest_path(e, ends.s, ends.t)


def chain_edges(d: Domain) -> DataFrame:
    """Subcontract edges with an id and a type by amount."""
    e = subcontracts(d)
    kind = F.when(F.col("amount") < 20000, "MINOR").when(F.col("amount") < 40000, "MEDIUM").otherwise("MAJOR")
    return e.select((F.col("src") * 1_000_000 + F.col("dst")).alias("id"), "src", "dst", kind.alias("type"), "amount")


CHAIN = SUB + """, chain AS (SELECT src * 1000000 + dst AS id, src, dst, CASE WHEN amount < 20000 THEN 'MINOR' WHEN amount < 40000 THEN 'MEDIUM' ELSE 'MAJOR' END AS type, amount FROM sub)"""


@query(oracle("""SELECT CAST(len(p) AS INT) AS hops, array_to_string(p, '>') AS cycle FROM walk WHERE EXISTS (SELECT 1 FROM sub s WHERE s.src = walk.at AND s.dst = walk.start)""", SUB + """,
walk AS (SELECT src AS start, dst AS at, [src, dst] AS p FROM sub WHERE dst > src UNION ALL SELECT w.start, s.dst, list_append(p, s.dst) FROM walk w JOIN sub s ON s.src = w.at WHERE s.dst > w.start AND NOT list_contains(p, s.dst) AND len(p) < 4)"""))
def cycles_2_4(d: Domain):
    """Subcontract cycles of two to four firms."""
    return op.cycles(subcontracts(d), 4)


@query(oracle("""SELECT CAST(len(used) AS INT) AS hops, array_to_string(p, '>') AS path, CAST(len(list_distinct(types)) AS INT) AS n_types FROM walk WHERE len(used) = 3 AND len(list_distinct(types)) >= 3 AND spot <> (SELECT min(src) FROM chain) ORDER BY n_types DESC, hops, path LIMIT 20""", CHAIN + """,
ways AS (SELECT id, src, dst, type FROM chain UNION ALL SELECT id, dst, src, type FROM chain),
walk AS (SELECT dst AS spot, [src, dst] AS p, [id] AS used, [type] AS types FROM ways WHERE src = (SELECT min(src) FROM chain) UNION ALL
 SELECT c.dst, list_append(p, c.dst), list_append(used, c.id), list_append(types, c.type) FROM walk w JOIN ways c ON c.src = w.spot WHERE NOT list_contains(used, c.id) AND len(used) < 3)"""))
def multi_hop_paths(d: Domain):
    """Twenty trails of three to six steps from the first firm over three kinds of edge, the most diverse and shortest first.

    The oracle takes three steps alone: there are more than twenty such trails with all three kinds.
    """
    e = chain_edges(d)
    start = e.agg(F.min("src")).first()[0]
    return trails.diverse_trails(e, start, 3, 6, 3, 20).select("hops", "path", "n_types")


@query(oracle("""SELECT CAST(hops AS INT) AS hops, path, amounts FROM (SELECT 2 AS hops, x.src || '>' || x.dst || '>' || x.src AS path, CAST(x.amount AS VARCHAR) || ',' || CAST(y.amount AS VARCHAR) AS amounts FROM subd x JOIN subd y ON x.dst = y.src AND y.dst = x.src)
 ORDER BY hops, path LIMIT 10""", SUB + ", subd AS (SELECT src, dst, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM sub)"))
def subcontract_cycles(d: Domain):
    """The ten first cycles of two to six steps from every firm, shortest first, with the amount of each step.

    The oracle takes two steps alone: there are more than ten such cycles.
    """
    return trails.first_cycles(subcontracts(d), 6, 10)


@query(oracle("""SELECT CAST(hops AS INT) AS hops, path FROM (SELECT 2 AS hops, x.src || '>' || x.dst || '>' || x.src AS path, x.src FROM sub x JOIN sub y ON x.dst = y.src AND y.dst = x.src
 UNION ALL SELECT 3, x.src || '>' || x.dst || '>' || y.dst || '>' || x.src, x.src FROM sub x JOIN sub y ON x.dst = y.src JOIN sub z ON y.dst = z.src AND z.dst = x.src) WHERE src = (SELECT min(src) FROM sub) ORDER BY hops, path LIMIT 5""", SUB))
def cycles_of_firm(d: Domain):
    """The five first cycles through one firm, shortest first."""
    e = subcontracts(d)
    return trails.first_cycles(e, 3, 5, e.agg(F.min("src")).first()[0]).select("hops", "path")


@query(oracle("SELECT x.src AS a, x.dst AS b, x.amount AS there, y.amount AS back FROM sub x JOIN sub y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst", SUB))
def reciprocal_loops(d: Domain):
    e = subcontracts(d)
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("amount").alias("back"))
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("amount").alias("there")).where("a < b").join(back, ["a", "b"])


@query(oracle("""SELECT x.firm AS a, y.firm AS b, count(*) AS contract_count, CASE WHEN count(*) >= 5 THEN 'frequent' ELSE 'occasional' END AS pattern
 FROM bids x JOIN bids y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2 HAVING count(*) >= 2"""))
def co_bidding_edges(d: Domain):
    """Pairs that bid on two or more contracts together."""
    pairs = rollups.co_pairs(d.bids).repartition(d.tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("contract_count")).where("contract_count >= 2")
    return pairs.withColumn("pattern", F.when(F.col("contract_count") >= 5, "frequent").otherwise("occasional"))


@query(oracle("""SELECT firm, partner, w, CAST(k AS INT) AS k FROM (SELECT a AS firm, b AS partner, w, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS k FROM
 (SELECT x.firm AS a, y.firm AS b, count(*) AS w FROM awards x JOIN awards y ON x.ref = y.ref AND x.firm <> y.firm GROUP BY 1, 2)) WHERE k <= 15"""))
def co_awardees(d: Domain):
    """The fifteen most frequent partners of each firm."""
    pairs = rollups.co_pairs(d.awards).groupBy("a", "b").agg(F.count("*").alias("w"))
    return op.ranked_neighbours(pairs, 15)


@query(oracle("""SELECT office, count(*) AS n_linked FROM (SELECT DISTINCT x.office, x.firm AS a, y.firm AS b FROM (SELECT DISTINCT office, firm FROM focus) x JOIN (SELECT DISTINCT office, firm FROM focus) y ON x.office = y.office AND x.firm < y.firm
 JOIN pairs p ON p.src = x.firm AND p.dst = y.firm) GROUP BY office""", PAIRS))
def agency_clusters(d: Domain):
    """Offices whose winners are linked by joint awards, with the number of linked pairs."""
    d.keep("focus")
    pairs = focus_pairs(d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return sets.pairs_by_item(pairs, d.focus, "firm", "office").select("office", F.col("n").alias("n_linked"))


@query(oracle("SELECT src AS id, count(*) AS degree FROM und GROUP BY 1 ORDER BY degree DESC, id LIMIT 10", PAIRS))
def most_connected(d: Domain):
    return op.degree(focus_pairs(d)).orderBy(F.desc("degree"), "id").limit(10)


@query(oracle("SELECT src AS id, count(*) AS n_strong FROM (SELECT src, dst FROM pairs WHERE weight >= 2 UNION SELECT dst, src FROM pairs WHERE weight >= 2) GROUP BY 1 HAVING count(*) >= 2", PAIRS))
def cobid_hubs(d: Domain):
    """Firms with two or more strong partners."""
    return op.degree(focus_pairs(d).where("weight >= 2")).select("id", F.col("degree").alias("n_strong")).where("n_strong >= 2")


@query(oracle("""SELECT src, dst, CAST(n AS BIGINT) AS shared FROM (SELECT x.firm AS src, y.firm AS dst, count(*) AS n FROM fo x JOIN fo y ON x.office = y.office AND x.firm < y.firm GROUP BY 1, 2) z
 WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM fj p JOIN fj q ON p.ref = q.ref WHERE p.firm = z.src AND q.firm = z.dst)""", "fo AS (SELECT DISTINCT firm, office FROM focus), fj AS (SELECT * FROM focus)"))
def co_located(d: Domain):
    """Firms that share three offices of focus contracts without a joint one."""
    d.keep("focus")
    held = d.focus.select(F.lit(0).alias("grp"), F.col("office").alias("item"), F.col("firm").alias("member"), F.lit(1.0).alias("x"), F.lit(1.0).alias("u")).distinct()
    joint = rollups.co_pairs(d.focus.select("ref", "firm")).select(F.lit(0).alias("grp"), "a", "b", F.lit(0).alias("since")).distinct()
    return blocks.sharing_pairs(held, joint, 3, ("src", "dst", "shared"))


@query(oracle("""SELECT 'AWARDED_TO' AS type, 'F' || firm AS source, 'O-' || office AS target, count(*) AS weight FROM focus GROUP BY 2, 3
 UNION ALL SELECT 'CO_AWARDED_WITH', 'F' || src, 'F' || dst, CAST(weight AS BIGINT) + 1 FROM pairs""", PAIRS))
def graph_edges(d: Domain):
    """Edges of the focus graph: firm to office by awards, firm to firm by joint awards plus one."""
    held = d.focus.groupBy(F.concat(F.lit("F"), "firm").alias("source"), F.concat(F.lit("O-"), "office").alias("target")).agg(F.count("*").alias("weight"))
    joint = focus_pairs(d).select(F.lit("CO_AWARDED_WITH").alias("type"), F.concat(F.lit("F"), "src").alias("source"), F.concat(F.lit("F"), "dst").alias("target"), (F.col("weight").cast("long") + 1).alias("weight"))
    return held.select(F.lit("AWARDED_TO").alias("type"), "source", "target", "weight").unionByName(joint)


@query(oracle("""SELECT firm FROM (SELECT DISTINCT firm FROM focus WHERE office IN (SELECT office FROM focus WHERE firm = (SELECT min(firm) FROM focus)))
 UNION SELECT dst FROM und WHERE src = (SELECT min(firm) FROM focus)""", PAIRS))
def ego_firms(d: Domain):
    """Firms within two hops of the smallest one over offices or joint awards."""
    held = d.focus.select("office", "firm").distinct()
    seed = held.agg(F.min("firm").alias("seed"))  # one row
    offices = held.join(F.broadcast(seed), F.col("firm") == F.col("seed"), "left_semi").select("office")
    partners = op.undirected(focus_pairs(d)).join(F.broadcast(seed), F.col("src") == F.col("seed"), "left_semi").select(F.col("dst").alias("firm"))
    return held.join(offices, "office", "left_semi").select("firm").union(partners).distinct()


@query(oracle("""SELECT firm, office, n FROM (SELECT f.firm, office, count(*) AS n, row_number() OVER (PARTITION BY f.firm ORDER BY count(*) DESC, office) AS k FROM focus f JOIN top USING (firm) GROUP BY 1, 2) WHERE k <= 6
 AND office IN (SELECT office FROM (SELECT f.firm, office, row_number() OVER (PARTITION BY f.firm ORDER BY count(*) DESC, office) AS k FROM focus f JOIN top USING (firm) GROUP BY 1, 2) WHERE k <= 6 GROUP BY 1 HAVING count(*) >= 2)""",
 "top AS (SELECT firm FROM focus GROUP BY 1 ORDER BY sum(amount) DESC, firm LIMIT 24)"))
def core_subgraph(d: Domain):
    """The 24 largest focus firms with their six main offices, where two of them meet."""
    from awardlens.plans.rollups import firm_top_offices

    top = d.focus.groupBy("firm").agg(F.sum("amount").alias("v")).orderBy(F.desc("v"), "firm").limit(24)
    held = firm_top_offices(d).join(F.broadcast(top.select("firm")), "firm", "left_semi")
    shared = held.groupBy("office").agg(F.count("*").alias("c")).where("c >= 2")
    return held.join(shared, "office", "left_semi").select("firm", "office", "n")
