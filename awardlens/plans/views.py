"""Views of the focus graph, listings of families, findings and enriched firms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.operators import blocks, dynasties, graph, order, rollups, sets, staging
from awardlens.operators.settle import settled
from awardlens.plans import flags as flag_plans
from awardlens.plans.flags import SUB, subcontracts
from awardlens.plans.network import PAIRS, focus_pairs
from awardlens.plans.registers import _FAM
from awardlens.plans.registry import registry
from awardlens.plans.temporal import LARGE, NAMED
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()
NAMES = ", ".join(map(str, NAMED))


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# ------------------------------------------------------------------ the graph's five kinds of edges


def located_parts(d: Domain, joint: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Offices of large firms and their joint awards for `blocks`; with `ids`, those of some ids alone."""
    large = d.focus.groupBy("firm").agg(F.sum("amount").alias("v")).where(F.col("v") >= LARGE).select("firm")
    if ids is not None:
        large = large.join(ids.select(F.col("id")), _id("F", "firm") == F.col("id"), "left_semi")
    large = settled(large, "large-firms")
    held = d.focus.join(large, "firm", "left_semi").select(F.lit(0).alias("grp"), F.col("office").alias("item"), F.col("firm").alias("member"), F.lit(1.0).alias("x"), F.lit(1.0).alias("u")).distinct()
    links = joint.join(large.withColumnRenamed("firm", "src"), "src", "left_semi").join(large.withColumnRenamed("firm", "dst"), "dst", "left_semi")
    return held, links.select(F.lit(0).alias("grp"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("since"))


def located_pairs(d: Domain, joint: DataFrame, ids: DataFrame | None = None, least: int = 3) -> DataFrame:
    """a, b, shared: large firms that share so many offices without a joint award; with `ids`, those of some ids alone."""
    return blocks.sharing_pairs(*located_parts(d, joint, ids), least)


def predicted_ties(d: Domain, joint: DataFrame, predicted: int = 40, least: int = 3) -> DataFrame:
    """a, b, common: of the pairs with most common partners those that are not large firms at so many common offices."""
    best = settled(graph.most_common_partners(joint, predicted), "ties")
    value = d.focus.groupBy("firm").agg(F.sum("amount").alias("v")).where(F.col("v") >= LARGE)
    at = settled(d.focus.join(F.broadcast(best.select(F.explode(F.array("a", "b")).alias("firm")).distinct()), "firm", "left_semi").select("firm", "office").distinct().join(value, "firm", "left_semi"), "tie-offices")
    shared = best.join(at.withColumnRenamed("firm", "a"), "a").join(at.withColumnRenamed("firm", "b"), ["b", "office"]).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return best.join(shared, ["a", "b"], "left_anti")


def located_rows(d: Domain, joint: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    none = F.lit(None)
    return located_pairs(d, joint, ids).select(F.lit("CO_LOCATED").alias("type"), F.lit("derived").alias("tier"), _id("F", "a").alias("source"), _id("F", "b").alias("target"), F.col("shared").cast("double").alias("weight"), none.cast("double").alias("value"), none.cast("int").alias("first_year"))


def owner_rows(d: Domain) -> DataFrame:
    none = F.lit(None)
    owners = d.officials.select("person").join(d.firms.select("firm", (F.col("firm") * 3).alias("person")), "person").join(d.focus.select("firm").distinct(), "firm", "left_semi")
    return owners.select(F.lit("PERSON_LINK").alias("type"), F.lit("recorded").alias("tier"), _id("P", "person").alias("source"), _id("F", "firm").alias("target"), F.lit(1.0).alias("weight"), none.cast("double").alias("value"), none.cast("int").alias("first_year"))


def typed_edge_rows(d: Domain, predicted: int = 40, ids: DataFrame | None = None) -> DataFrame:
    """type, tier, source, target, weight, value, first_year.

    Recorded: firm to office by awards, firms by joint awards, persons to firms they own. Derived: large firms that
    share three offices without a joint award. Predicted: the pairs with most common partners that have no other edge.
    With `ids`, the edges whose two ends are among them.
    """
    d.keep("focus")
    none = F.lit(None)
    pairs = rollups.co_pairs(d.focus.select("ref", "firm", "year", "amount"), carry=("year", "amount"))
    joint = settled(pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").cast("double").alias("weight"), F.min("year").alias("year"), F.sum("amount").cast("double").alias("value")), "joint-pairs")
    held = d.focus.groupBy("firm", "office").agg(F.count("*").cast("double").alias("weight"), F.sum("amount").cast("double").alias("value"), F.min("year").alias("first_year"))
    awarded = held.select(F.lit("AWARDED_TO").alias("type"), F.lit("recorded").alias("tier"), _id("F", "firm").alias("source"), _id("O-", "office").alias("target"), "weight", F.round("value", 2).alias("value"), "first_year")
    together = joint.select(F.lit("CO_AWARDED_WITH").alias("type"), F.lit("recorded").alias("tier"), _id("F", "src").alias("source"), _id("F", "dst").alias("target"), "weight", F.round("value", 2).alias("value"), F.col("year").alias("first_year"))
    located, persons = located_rows(d, joint, ids), owner_rows(d)
    ties = predicted_ties(d, joint, predicted).select(F.lit("PREDICTED_TIE").alias("type"), F.lit("predicted").alias("tier"), _id("F", "a").alias("source"), _id("F", "b").alias("target"), F.lit(1.0).alias("weight"), F.col("common").cast("double").alias("value"), none.cast("int").alias("first_year"))
    others = reduce(DataFrame.unionByName, (awarded, together, persons, ties))
    return (others if ids is None else within(others, ids)).unionByName(located)


TYPED = PAIRS + f""", large AS (SELECT firm FROM focus GROUP BY 1 HAVING sum(amount) >= {LARGE}), fo AS (SELECT DISTINCT firm, office FROM focus),
 open AS (SELECT x.src AS a, y.src AS b, count(*) AS common FROM und x JOIN und y ON x.dst = y.dst AND x.src < y.src WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.src = x.src AND p.dst = y.src) GROUP BY 1, 2),
 located AS (SELECT x.firm AS a, y.firm AS b, count(*) AS n FROM fo x JOIN fo y ON x.office = y.office AND x.firm < y.firm WHERE x.firm IN (SELECT firm FROM large) AND y.firm IN (SELECT firm FROM large) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.src = x.firm AND p.dst = y.firm) GROUP BY 1, 2 HAVING count(*) >= 3),
 typed AS (SELECT 'AWARDED_TO' AS type, 'recorded' AS tier, 'F' || firm AS source, 'O-' || office AS target, CAST(count(*) AS DOUBLE) AS weight, round(CAST(sum(amount) AS DOUBLE), 2) AS value, min(year) AS first_year FROM focus GROUP BY firm, office
 UNION ALL SELECT 'CO_AWARDED_WITH', 'recorded', 'F' || x.firm, 'F' || y.firm, CAST(count(*) AS DOUBLE), round(CAST(sum(x.amount) AS DOUBLE), 2), min(x.year) FROM focus x JOIN focus y ON x.ref = y.ref AND x.firm < y.firm GROUP BY x.firm, y.firm
 UNION ALL SELECT 'CO_LOCATED', 'derived', 'F' || a, 'F' || b, CAST(n AS DOUBLE), NULL, NULL FROM located
 UNION ALL SELECT 'PERSON_LINK', 'recorded', 'P' || person, 'F' || firm, 1.0, NULL, NULL FROM firms JOIN officials ON person = firm * 3 WHERE firm IN (SELECT firm FROM focus)
 UNION ALL SELECT 'PREDICTED_TIE', 'predicted', 'F' || a, 'F' || b, 1.0, CAST(common AS DOUBLE), NULL FROM (SELECT * FROM open ORDER BY common DESC, a, b LIMIT 40) WHERE (a, b) NOT IN (SELECT (a, b) FROM located))"""


@query(oracle("SELECT * FROM typed", TYPED))
def typed_edges(d: Domain):
    """All edges of the focus graph: awards, joint awards, shared offices, owners, predicted ties."""
    return typed_edge_rows(d)


def core_members(d: Domain, best: int = 24, offices_each: int = 6, others: int = 36) -> DataFrame:
    """`id, kind`: the largest focus firms with all revoked and named ones, the offices among their main ones that two share, and the
    others of most value."""
    d.keep("focus")
    sums = d.focus.groupBy("firm").agg(F.sum("amount").alias("v"))
    revoked = d.awards.where("ref % 500 = 0").select("firm").distinct()
    focus_firms = sums.select("firm")
    firms = sums.orderBy(F.desc("v"), "firm").limit(best).select("firm").union(focus_firms.join(revoked, "firm", "left_semi")).union(focus_firms.where(F.col("firm").isin(list(NAMED)))).distinct()
    firms = settled(firms, "core-firms")
    own = d.focus.join(firms, "firm", "left_semi").groupBy("firm", "office").agg(F.sum("amount").alias("v"))
    top = own.withColumn("k", F.row_number().over(Window.partitionBy("firm").orderBy(F.desc("v"), "office"))).where(F.col("k") <= offices_each)
    hits = settled(top.groupBy("office").agg(F.count("*").alias("hits"), F.sum("v").alias("v")), "core-offices")
    offices = hits.where("hits >= 2").select("office").union(hits.where("hits < 2").orderBy(F.desc("v"), "office").limit(others).select("office"))
    return firms.select(_id("F", "firm").alias("id"), F.lit("firm").alias("kind")).unionByName(offices.select(_id("O-", "office").alias("id"), F.lit("office").alias("kind")))


CORE = TYPED + f""", cf AS (SELECT firm FROM (SELECT firm FROM focus GROUP BY 1 ORDER BY sum(amount) DESC, firm LIMIT 24) UNION SELECT firm FROM focus WHERE firm IN (SELECT firm FROM awards WHERE ref % 500 = 0) OR firm IN ({NAMES})),
 ct AS (SELECT firm, office, v FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY v DESC, office) AS k FROM (SELECT firm, office, sum(amount) AS v FROM focus SEMI JOIN cf USING (firm) GROUP BY 1, 2)) WHERE k <= 6),
 ch AS (SELECT office, count(*) AS hits, sum(v) AS v FROM ct GROUP BY 1), core AS (SELECT 'F' || firm AS id, 'firm' AS kind FROM cf UNION ALL SELECT 'O-' || office, 'office' FROM ch WHERE hits >= 2 UNION ALL SELECT 'O-' || office, 'office' FROM (SELECT office FROM ch WHERE hits < 2 ORDER BY v DESC, office LIMIT 36))"""


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose two ends are among some ids."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(edges.columns)


@query(oracle("SELECT id, kind FROM core", CORE))
def core_graph_nodes(d: Domain):
    return core_members(d)


@query(oracle("SELECT * FROM typed WHERE source IN (SELECT id FROM core) AND target IN (SELECT id FROM core)", CORE))
def core_graph_edges(d: Domain):
    """All kinds of edges among the core's firms and offices."""
    return typed_edge_rows(d, ids=settled(core_members(d), "core"))


EGO = TYPED + """, seed AS (SELECT min(firm) AS s FROM focus), ef AS (SELECT s AS firm FROM seed UNION SELECT dst FROM und WHERE src = (SELECT s FROM seed)),
 ego AS (SELECT 'F' || firm AS id FROM ef UNION SELECT 'O-' || office FROM focus WHERE firm IN (SELECT firm FROM ef))"""


@query(oracle("SELECT * FROM typed WHERE source IN (SELECT id FROM ego) AND target IN (SELECT id FROM ego)", EGO))
def ego_graph_edges(d: Domain):
    """All kinds of edges among the first firm, its partners, and the offices of them all."""
    d.keep("focus")
    seed = d.focus.agg(F.min("firm").alias("firm"))  # one row
    partners = graph.undirected(focus_pairs(d)).join(F.broadcast(seed), F.col("src") == F.col("firm"), "left_semi").select(F.col("dst").alias("firm"))
    firms = settled(seed.union(partners).distinct(), "ego-firms")
    offices = d.focus.join(firms, "firm", "left_semi").select("office").distinct()
    return typed_edge_rows(d, ids=settled(firms.select(_id("F", "firm").alias("id")).union(offices.select(_id("O-", "office").alias("id"))), "ego"))


@query(oracle("SELECT type, source, target FROM recorded WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)", TYPED + """, recorded AS (SELECT * FROM typed WHERE type IN ('PERSON_LINK', 'CO_LOCATED')), ru AS (SELECT source AS a, target AS b FROM recorded UNION SELECT target, source FROM recorded),
 walk AS (SELECT min(a) AS id, 0 AS depth FROM ru UNION SELECT ru.b, walk.depth + 1 FROM walk JOIN ru ON ru.a = walk.id WHERE walk.depth < 3), near AS (SELECT DISTINCT id FROM walk)"""))
def subgraph_at_depth(d: Domain, depth: int = 3):
    """Owners and shared offices within some steps of the first firm: every such edge between two nodes that lie within."""
    d.keep("focus")
    joint = settled(rollups.co_pairs(d.focus.select("ref", "firm")).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "joint-pairs")
    held, links = (settled(x, "located-parts") for x in located_parts(d, joint))
    owners = settled(owner_rows(d).select("type", "source", "target"), "owner-edges")
    seen = _steps_over_places(owners, held, links, depth)
    ids = settled(seen.select("id"), "depth-nodes")
    near = ids.join(held.select("member").distinct(), F.col("id") == _id("F", "member")).select("member")
    among = held.join(near, "member", "left_semi"), links.join(near.withColumnRenamed("member", "a"), "a", "left_semi").join(near.withColumnRenamed("member", "b"), "b", "left_semi")
    located = blocks.sharing_pairs(*among, 3).select(F.lit("CO_LOCATED").alias("type"), _id("F", "a").alias("source"), _id("F", "b").alias("target"))
    return within(owners, ids).unionByName(located)


def _steps_over_places(owners: DataFrame, held: DataFrame, links: DataFrame, depth: int, least: int = 3) -> DataFrame:
    """`id, dist` of all nodes within some steps of the first one over owners and shared offices; firms are reached in blocks, and no edge between them is written."""
    firms = held.select("member").distinct()
    both = owners.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(owners.select(F.col("target").alias("a"), F.col("source").alias("b")))
    owned = both.agg(F.min("a").alias("least"))  # one row
    earlier = firms.crossJoin(F.broadcast(owned)).select("member", F.lit(True).alias("front"), F.coalesce(_id("F", "member") < F.col("least"), F.lit(True)).alias("asked"))
    first = both.select(F.col("a").alias("id"))
    if not earlier.where("asked").isEmpty():
        first = first.unionByName(blocks.met_members(held, links, earlier, least).select(_id("F", "member").alias("id")))
    start = first.agg(F.min("id").alias("id")).where("id IS NOT NULL")  # one row
    seen = settled(start.withColumn("dist", F.lit(0)), "depth-seen")
    for d in range(1, depth + 1):
        flags = firms.select("member", _id("F", "member").alias("id")).join(seen, "id", "left").select("member", F.coalesce(F.col("dist") == d - 1, F.lit(False)).alias("front"), F.col("dist").isNull().alias("asked"))
        step = both.join(seen.where(F.col("dist") == d - 1).select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"))
        if not flags.where("front").isEmpty():
            step = step.unionByName(blocks.met_members(held, links, flags, least).select(_id("F", "member").alias("id")))
        seen = settled(seen.unionByName(step.distinct().join(seen, "id", "left_anti").withColumn("dist", F.lit(d))), "depth-seen")
    return seen


# ------------------------------------------------------------------ loops, hubs, communities, shared officers


@query(oracle("""SELECT x.src AS a, x.dst AS b, p.surname || ' ' || p.person AS owner_a, q.surname || ' ' || q.person AS owner_b FROM sub x JOIN sub y ON x.src = y.dst AND x.dst = y.src
 LEFT JOIN officials p ON p.person = x.src * 3 LEFT JOIN officials q ON q.person = x.dst * 3 WHERE x.src < x.dst""", SUB))
def loop_owners(d: Domain):
    """Firms that subcontract to each other, with the officials who own them."""
    e = subcontracts(d).select("src", "dst")
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    owner = lambda c: d.officials.select((F.col("person") / 3).alias(c), F.concat_ws(" ", "surname", "person").alias(f"owner_{c}")).where(F.col(c) == F.floor(c)).withColumn(c, F.col(c).cast("long"))
    loops = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a < b").join(back, ["a", "b"])
    return loops.join(owner("a"), "a", "left").join(owner("b"), "b", "left").select("a", "b", "owner_a", "owner_b")


@query(oracle("""SELECT hub, n_connections, partner, relationship, CAST(k AS INT) AS k FROM (SELECT h.*, l.b AS partner, l.kind AS relationship, row_number() OVER (PARTITION BY hub ORDER BY l.b, l.kind) AS k FROM hubs h JOIN links l ON l.a = h.hub) WHERE k <= 20""",
 """cob AS (SELECT x.firm AS a, y.firm AS b, count(*) AS n FROM bids x JOIN bids y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2 HAVING count(*) >= 2), dir AS (SELECT x.firm AS a, y.firm AS b FROM firms x JOIN firms y ON x.firm % 30 = y.firm % 30 AND x.firm < y.firm),
 links AS (SELECT a, b, 'CO_BID_WITH' AS kind FROM cob UNION ALL SELECT b, a, 'CO_BID_WITH' FROM cob UNION ALL SELECT a, b, 'SHARES_DIRECTOR_WITH' FROM dir UNION ALL SELECT b, a, 'SHARES_DIRECTOR_WITH' FROM dir),
 strong AS (SELECT a AS f FROM cob WHERE n >= 3 UNION SELECT b FROM cob WHERE n >= 3), hubs AS (SELECT a AS hub, count(DISTINCT b) AS n_connections FROM links WHERE a IN (SELECT f FROM strong) GROUP BY 1 HAVING count(DISTINCT b) >= 3 ORDER BY 2 DESC, 1 LIMIT 50)"""))
def hub_neighbours(d: Domain, least: int = 3, hubs: int = 50, shown: int = 20):
    """The fifty firms with most co-bidders and common directors, each with twenty of them."""
    cob = settled(rollups.co_pairs(d.bids).repartition(d.tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2"), "co-bids")
    bidders = cob.select("a", "b", "n").unionByName(cob.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    own = settled(sets.sharing_members(flag_plans.directors(d), "firm", "director"), "director-sets")
    # those who share a director are counted by sets; of the co-bidders only the others are added
    led = lambda c: own.select(F.col("firm").alias(c), F.col("items").alias(f"led_{c}"))
    apart = ~F.coalesce(F.arrays_overlap("led_a", "led_b"), F.lit(False))
    others = bidders.join(led("a"), "a", "left").join(led("b"), "b", "left").groupBy(F.col("a").alias("hub")).agg(F.count(F.when(apart, 1)).alias("more"), F.max("n").alias("most"))
    n = (F.col("more") + F.coalesce("n", F.lit(0))).alias("n_connections")
    counted = others.where(F.col("most") >= least).join(own.select(F.col("firm").alias("hub"), "n"), "hub", "left").select("hub", n)
    best = settled(counted.where(F.col("n_connections") >= least).orderBy(F.desc("n_connections"), "hub").limit(hubs), "hubs")
    asked = best.select(F.col("hub").alias("a"))
    held = own.select(F.col("firm").alias("b"), F.explode("items").alias("director"))
    mates = held.join(F.broadcast(held.join(F.broadcast(asked), F.col("b") == F.col("a"), "left_semi").select(F.col("b").alias("a"), "director")), "director").where("a <> b").select("a", "b").distinct()
    links = bidders.join(F.broadcast(asked), "a", "left_semi").select("a", "b", F.lit("CO_BID_WITH").alias("kind")).unionByName(mates.withColumn("kind", F.lit("SHARES_DIRECTOR_WITH")))
    seen = links.join(F.broadcast(best), F.col("a") == F.col("hub"))
    by = Window.partitionBy("hub").orderBy("b", "kind")
    return seen.withColumn("k", F.row_number().over(by)).where(F.col("k") <= shown).select("hub", "n_connections", F.col("b").alias("partner"), F.col("kind").alias("relationship"), "k")


_COMM = PAIRS + ", w AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), l0 AS (SELECT DISTINCT src AS id, src AS label FROM w), " + ", ".join(f"l{k} AS (SELECT id, max_by(label, (v, -label)) AS label FROM (SELECT w.src AS id, l.label, sum(weight) AS v FROM w JOIN l{k - 1} l ON l.id = w.dst GROUP BY 1, 2) GROUP BY id)" for k in range(1, 6))


@query(oracle("""SELECT label, 'member' AS part, id AS a, CAST(NULL AS BIGINT) AS b, NULL AS summary FROM l5 UNION ALL SELECT x.label, 'edge', p.src, p.dst, NULL FROM pairs p JOIN l5 x ON p.src = x.id JOIN l5 y ON p.dst = y.id WHERE x.label = y.label
 UNION ALL SELECT label, 'summary', NULL, NULL, 'Community ' || label || ': ' || n || ' members, ' || (SELECT count(*) FROM pairs p JOIN l5 x ON p.src = x.id JOIN l5 y ON p.dst = y.id WHERE x.label = z.label AND y.label = z.label) || ' internal edges' FROM (SELECT label, count(*) AS n FROM l5 GROUP BY 1) z""", _COMM))
def community_members(d: Domain):
    """Of every community its members, the edges inside it and a summary, a row each."""
    e = settled(focus_pairs(d), "joint-pairs")
    labels = settled(graph.label_propagation(e, 5), "community-labels")
    none = F.lit(None)
    ends = e.join(labels.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst").where("x = y")
    members = labels.select("label", F.lit("member").alias("part"), F.col("id").alias("a"), none.cast("long").alias("b"), none.cast("string").alias("summary"))
    edges = ends.select(F.col("x").alias("label"), F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), none.cast("string").alias("summary"))
    counts = labels.groupBy("label").agg(F.count("*").alias("n")).join(ends.groupBy(F.col("x").alias("label")).agg(F.count("*").alias("m")), "label", "left")
    text = F.concat(F.lit("Community "), "label", F.lit(": "), "n", F.lit(" members, "), F.coalesce("m", F.lit(0)), F.lit(" internal edges"))
    return members.unionByName(edges).unionByName(counts.select("label", F.lit("summary").alias("part"), none.cast("long").alias("a"), none.cast("long").alias("b"), text.alias("summary")))


@query(oracle("""SELECT x.firm AS a, y.firm AS b, 'shared_address' AS association, x.home || '-' || (x.firm % 7) AS shared FROM firms x JOIN firms y ON x.home = y.home AND x.firm % 7 = y.firm % 7 AND x.firm < y.firm
 UNION ALL SELECT x.firm, y.firm, 'shared_officer', 'Officer ' || (x.firm % 30) FROM firms x JOIN firms y ON x.firm % 30 = y.firm % 30 AND x.firm < y.firm"""))
def shared_entities(d: Domain):
    """Pairs of firms with an address or an officer in common, and what they share."""
    kinds = {"shared_address": F.concat_ws("-", "home", (F.col("firm") % 7).cast("string")), "shared_officer": F.concat(F.lit("Officer "), (F.col("firm") % 30).cast("string"))}
    parts = [rollups.co_pairs(d.firms.select(key.alias("shared"), "firm"), "shared").select("a", "b", F.lit(kind).alias("association"), "shared") for kind, key in kinds.items()]
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------ families, findings, firms


@query(oracle(f"""SELECT CAST(rank() OVER (ORDER BY dynasty_score DESC, surname, province) AS INT) AS place, surname, province, dynasty_score, dynasty_type, member_count, person AS member FROM ({_FAM}) JOIN (SELECT surname, province, person FROM officials) USING (surname, province)"""))
def dynasty_listing(d: Domain):
    """Families by score, from the highest, with a row for each member."""
    found = dynasties.families(d.officials).select("surname", "province", "dynasty_score", "dynasty_type", "member_count")
    placed = found.withColumn("n", F.sum("member_count").over(Window.orderBy(F.desc("dynasty_score"), "surname", "province").rowsBetween(Window.unboundedPreceding, -1)))  # one row for each family
    rows = placed.select((F.coalesce("n", F.lit(0)) + 1).cast("int").alias("place"), *found.columns)
    return rows.join(d.officials.select("surname", "province", F.col("person").alias("member")), ["surname", "province"]).select("place", "surname", "province", "dynasty_score", "dynasty_type", "member_count", "member")


@query(oracle("""SELECT entity, event_id, type, severity, amount, year, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC, severity DESC, event_id) AS k FROM
 (SELECT user_id AS entity, event_id, event_type AS type, CASE WHEN event_type = 'purchase' THEN 'high' WHEN event_type = 'click' THEN 'medium' ELSE 'low' END AS severity, coalesce(CAST(value AS DOUBLE), 0) AS amount, CAST(year(ts) AS INT) AS year FROM events)) WHERE k <= 10"""))
def entity_findings(d: Domain, most: int = 10):
    """The ten latest and gravest findings of every entity."""
    kind = F.when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    rows = d.table("events").select(F.col("user_id").alias("entity"), "event_id", F.col("event_type").alias("type"), kind.alias("severity"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("amount"), F.year("ts").alias("year"))
    by = Window.partitionBy("entity").orderBy(F.desc("year"), F.desc("severity"), "event_id")
    return rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)


def _pesos(v: str) -> str:
    steps = " ".join(f"WHEN {v} >= {by} THEN format('{{:,.2f}}', {v} / {by}) || '{unit}'" for by, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")))
    return f"CASE {steps} ELSE format('{{:,.2f}}', {v}) END"


@query(oracle(f"""SELECT kind, id, {_pesos('v')} AS amount FROM (SELECT 'all' AS kind, 'contracts' AS id, CAST(sum(amount) AS DOUBLE) AS v FROM contracts UNION ALL SELECT 'office', office, CAST(sum(amount) AS DOUBLE) FROM contracts GROUP BY office
 UNION ALL SELECT 'firm', CAST(firm AS VARCHAR), CAST(sum(amount) AS DOUBLE) FROM focus GROUP BY firm UNION ALL SELECT 'contract', CAST(ref AS VARCHAR), CAST(amount AS DOUBLE) FROM contracts)"""))
def formatted_amounts(d: Domain):
    """Totals of all contracts, of offices, of firms and of single contracts as they are shown, with a unit."""
    d.keep("contracts")
    total = lambda rows, kind, key: rows.agg(F.sum("amount").cast("double").alias("v")).select(F.lit(kind).alias("kind"), key.alias("id"), "v")
    single = d.contracts.select(F.lit("contract").alias("kind"), F.col("ref").cast("string").alias("id"), F.col("amount").cast("double").alias("v"))
    rows = total(d.contracts.groupBy(), "all", F.lit("contracts")).unionByName(total(d.contracts.groupBy("office"), "office", F.col("office"))).unionByName(total(d.focus.groupBy("firm"), "firm", F.col("firm").cast("string"))).unionByName(single)
    return rows.select("kind", "id", fn.pesos(F.col("v")).alias("amount"))


@query(oracle("""SELECT firm, name, 'Old ' || min(ref) AS former, count(*) AS n_cells FROM awards JOIN (SELECT firm, name FROM firms) USING (firm) WHERE ref % 7 = 0 GROUP BY 1, 2"""))
def re_registrations(d: Domain):
    """Firms whose contracts name them as formerly another one: the name of the first such contract, and how many there are."""
    cell = F.concat("name", F.when(F.col("ref") % 7 == 0, F.concat(F.lit(" (Formerly: Old "), "ref", F.lit(")"))).otherwise(F.lit("")))
    cells = d.awards.select("ref", "firm").join(d.firms.select("firm", "name"), "firm").select("ref", "firm", "name", F.explode(fn.contractor_cell(cell)).alias("c"))
    found = cells.where("c.former IS NOT NULL").groupBy("firm", "name")
    return found.agg(F.min_by("c.former", "ref").alias("former"), F.count("*").alias("n_cells"))


@query(oracle("""SELECT surname || ' ' || person AS head, 'Person' AS head_type, 'linked_to' AS relation, CAST(firm AS VARCHAR) AS tail, 'Firm' AS tail_type, strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n_sources FROM officials JOIN firms ON person = firm * 3
  LEFT JOIN (SELECT customer AS person, min_by(award_date, ref) FILTER (ref % 10 <> 0) AS day, count(*) AS n FROM contracts GROUP BY 1) USING (person)
 UNION ALL SELECT CAST(firm AS VARCHAR), 'Firm', event_type, left(coalesce(props, ''), 60), 'Institution', strftime(ts, '%Y-%m-%d'), 1 FROM firms JOIN events ON user_id = firm"""))
def dated_edges(d: Domain):
    """Typed edges with a date: officials to the firms they own, dated by the first of their contracts that has a date (every tenth has none), and
    firms to what happened to them, under a label of sixty characters."""
    owned = d.officials.join(d.firms.select((F.col("firm") * 3).alias("person"), "firm"), "person")
    dated = F.when(F.col("ref") % 10 != 0, F.col("ref"))
    sources = d.contracts.groupBy(F.col("customer").alias("person")).agg(F.min_by(F.when(dated.isNotNull(), F.col("award_date")), dated).alias("day"), F.count("*").alias("n"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    persons = owned.join(sources, "person", "left").select(F.concat_ws(" ", "surname", "person").alias("head"), F.lit("Person").alias("head_type"), F.lit("linked_to").alias("relation"), F.col("firm").cast("string").alias("tail"), F.lit("Firm").alias("tail_type"), day("day"), F.coalesce("n", F.lit(0)).alias("n_sources"))
    events = d.table("events").join(d.firms.select(F.col("firm").alias("user_id")), "user_id")
    actions = events.select(F.col("user_id").cast("string").alias("head"), F.lit("Firm").alias("head_type"), F.col("event_type").alias("relation"), F.left(F.coalesce("props", F.lit("")), F.lit(60)).alias("tail"), F.lit("Institution").alias("tail_type"), day("ts"), F.lit(1).cast("long").alias("n_sources"))
    return persons.unionByName(actions)


@query(oracle("""SELECT firm, name, owner, capital, CASE WHEN capital > 0 THEN round(v / capital, 1) END AS contract_to_capital, coalesce(mentions, 0) AS mentions FROM (SELECT firm, name, CAST(capital AS DOUBLE) AS capital FROM firms) JOIN (SELECT firm, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1) USING (firm)
 LEFT JOIN (SELECT CAST(person / 3 AS BIGINT) AS firm, surname || ' ' || person AS owner FROM officials WHERE person % 3 = 0) USING (firm) LEFT JOIN (SELECT user_id AS firm, count(*) AS mentions FROM events WHERE event_type = 'view' GROUP BY 1) USING (firm)"""))
def enriched_firms(d: Domain):
    """Focus firms with their owner in office, their registered capital against awards, and how often they are mentioned; a registry record of an unknown firm is an error."""
    value = d.focus.groupBy("firm").agg(F.sum("amount").cast("double").alias("v"))
    records = d.firms.select("firm", F.col("capital").cast("double").alias("capital")).join(value, "firm", "left_semi")
    owners = d.officials.where("person % 3 = 0").select((F.col("person") / 3).cast("long").alias("firm"), F.concat_ws(" ", "surname", "person").alias("owner"))
    news = d.table("events").where("event_type = 'view'").groupBy(F.col("user_id").alias("firm")).agg(F.count("*").alias("mentions"))
    rows = staging.enriched(d.firms.select("firm", "name").join(value, "firm"), "firm", required=[records], optional=[owners, news])
    return rows.select("firm", "name", "owner", "capital", F.when(F.col("capital") > 0, F.round(F.col("v") / F.col("capital"), 1)).alias("contract_to_capital"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


_TOP = """ranked AS (SELECT firm, office, n, row_number() OVER (PARTITION BY firm ORDER BY v DESC, office) AS k FROM (SELECT firm, office, count(*) AS n, sum(amount) AS v FROM awards GROUP BY 1, 2)),
 co AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM (SELECT x.firm AS a, y.firm AS b, count(*) AS n FROM awards x JOIN awards y ON x.ref = y.ref AND x.firm <> y.firm GROUP BY 1, 2))"""


@query(oracle("""SELECT CAST(row_number() OVER (ORDER BY val DESC, id) AS INT) AS place, * FROM (SELECT 'F' || firm AS id, 'firm' AS kind, name AS label, coalesce(v, 0.0) AS val,
 (SELECT string_agg(office || ':' || n, ',' ORDER BY k) FROM ranked r WHERE r.firm = f.firm AND k <= 10) AS top_offices, (SELECT string_agg(b || ':' || n, ',' ORDER BY k) FROM co WHERE a = f.firm AND k <= 15) AS partners FROM firms f LEFT JOIN (SELECT firm, CAST(sum(amount) AS DOUBLE) AS v FROM awards GROUP BY 1) USING (firm)
 UNION ALL SELECT 'O-' || office, 'office', office, CAST(sum(amount) AS DOUBLE), NULL, NULL FROM contracts GROUP BY office UNION ALL SELECT 'P' || person, 'person', surname || ' ' || person, 0.0, NULL, NULL FROM officials)""", _TOP))
def search_rows(d: Domain):
    """All that can be searched, by value: firms with their ten main offices and fifteen most frequent partners, offices, persons."""
    d.keep("awards")
    own = d.awards.groupBy("firm", "office").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("firm").orderBy(F.desc("v"), "office"))).where("k <= 10")
    together = rollups.co_pairs(d.awards.select("ref", "firm").repartition(d.tasks, "ref")).repartition(d.tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("w"))
    near = graph.ranked_neighbours(together, 15, d.tasks)
    listed = lambda rows, item, n, name: rows.groupBy("firm").agg(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(":", item, n).alias("x")))).alias("s")).select("firm", F.array_join(F.transform("s", lambda y: y["x"]), ",").alias(name))
    sums = d.awards.groupBy("firm").agg(F.sum("amount").cast("double").alias("v"))
    none = F.lit(None).cast("string")
    firms = d.firms.join(sums, "firm", "left").join(listed(ranked, "office", "n", "top_offices"), "firm", "left").join(listed(near, "partner", "w", "partners"), "firm", "left")
    rows = firms.select(_id("F", "firm").alias("id"), F.lit("firm").alias("kind"), F.col("name").alias("label"), F.coalesce("v", F.lit(0.0)).alias("val"), "top_offices", "partners")
    offices = d.contracts.groupBy("office").agg(F.sum("amount").cast("double").alias("val")).select(_id("O-", "office").alias("id"), F.lit("office").alias("kind"), F.col("office").alias("label"), "val", none.alias("top_offices"), none.alias("partners"))
    people = d.officials.select(_id("P", "person").alias("id"), F.lit("person").alias("kind"), F.concat_ws(" ", "surname", "person").alias("label"), F.lit(0.0).alias("val"), none.alias("top_offices"), none.alias("partners"))
    every = settled(rows.unionByName(offices).unionByName(people), "search-rows")
    return order.numbered(every, [F.desc("val"), F.col("id")], "place")
