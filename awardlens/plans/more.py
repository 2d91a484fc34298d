"""Extractions, communities, predicted ties and text for answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.operators import embed, graph, sets, walks
from awardlens.operators.settle import settled
from awardlens.plans.network import PAIRS, focus_pairs
from awardlens.plans.registry import registry
from awardlens.plans.temporal import big_firms
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()


@query(oracle("""SELECT firm, count(*) AS total_contracts, CAST(sum(amount) AS DOUBLE) AS total_value, string_agg(DISTINCT region, ',' ORDER BY region) AS regions, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM awards GROUP BY 1"""))
def contractor_extract(d: Domain):
    """Firms with their totals and sorted lists of regions and categories."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return d.awards.groupBy("firm").agg(F.count("*").alias("total_contracts"), F.sum("amount").cast("double").alias("total_value"), listed("region").alias("regions"), listed("category").alias("categories"))


@query(oracle("""SELECT f.firm, p.person, 'low' AS confidence FROM (SELECT *, 'CLAN' || (firm % 40) AS surname FROM firms) f JOIN officials p ON p.surname = f.surname AND p.province = f.home"""))
def surname_links(d: Domain):
    """Firms whose owner's surname and place are those of an official."""
    owners = d.firms.select("firm", F.concat(F.lit("CLAN"), (F.col("firm") % 40).cast("string")).alias("surname"), F.col("home").alias("province"))
    return owners.join(d.officials, ["surname", "province"]).select("firm", "person", F.lit("low").alias("confidence"))


@query(oracle("""SELECT firm, home, n_home, n - n_home AS n_away, n_regions, round(n_regions / 5.0, 4) AS diversity FROM (SELECT firm, arg_max(region, (c, region)) AS home, CAST(max(c) AS BIGINT) AS n_home, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_regions FROM (SELECT firm, region, count(*) AS c FROM focus GROUP BY 1, 2) GROUP BY 1) WHERE n_regions >= 3"""))
def multi_region(d: Domain):
    """Firms active in three regions or more: home is the most frequent one."""
    counted = d.focus.groupBy("firm", "region").agg(F.count("*").alias("c"))
    best = counted.groupBy("firm").agg(F.max_by("region", F.struct("c", "region")).alias("home"), F.max("c").alias("n_home"), F.sum("c").alias("n"), F.count("*").alias("n_regions"))
    return best.where("n_regions >= 3").select("firm", "home", "n_home", (F.col("n") - F.col("n_home")).alias("n_away"), "n_regions", F.round(F.col("n_regions") / 5.0, 4).alias("diversity"))


@query(oracle("""SELECT firm FROM (SELECT firm FROM awards GROUP BY 1 ORDER BY sum(amount) DESC, firm LIMIT 20) UNION SELECT firm FROM firms WHERE capital < 0 UNION SELECT src FROM und""", PAIRS))
def capped_firms(d: Domain, n: int = 20):
    """The largest firms, with all flagged ones and all in joint awards whatever their size."""
    top = d.awards.groupBy("firm").agg(F.sum("amount").alias("v")).orderBy(F.desc("v"), "firm").limit(n).select("firm")
    joint = graph.undirected(focus_pairs(d)).select(F.col("src").alias("firm"))
    return top.union(d.firms.where("capital < 0").select("firm")).union(joint).distinct()


@query(oracle("""SELECT label, count(DISTINCT id) AS n_members, (SELECT count(*) FROM pairs p JOIN l5 x ON p.src = x.id JOIN l5 y ON p.dst = y.id WHERE x.label = z.label AND y.label = z.label) AS n_inner FROM l5 z GROUP BY label""",
 PAIRS + ", w AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), l0 AS (SELECT DISTINCT src AS id, src AS label FROM w), "
 + ", ".join(f"l{k} AS (SELECT id, max_by(label, (v, -label)) AS label FROM (SELECT w.src AS id, l.label, sum(weight) AS v FROM w JOIN l{k - 1} l ON l.id = w.dst GROUP BY 1, 2) GROUP BY id)" for k in range(1, 6))))
def community_detail(d: Domain):
    """Members of each community and the edges inside it."""
    e = focus_pairs(d)
    labels = graph.label_propagation(e, 5)
    ends = e.join(labels.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst")
    inner = ends.where("x = y").groupBy(F.col("x").alias("label")).agg(F.count("*").alias("n"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n_members"))
    return sizes.join(inner, "label", "left").select("label", "n_members", F.coalesce("n", F.lit(0)).alias("n_inner"))


@query(oracle("""SELECT office, string_agg('- ' || name || ' (' || n || ' awards)', chr(10) ORDER BY k) AS context FROM (SELECT office, name, n, k FROM (SELECT office, firm, n, row_number() OVER (PARTITION BY office ORDER BY n DESC, firm) AS k FROM (SELECT office, firm, count(*) AS n FROM focus GROUP BY 1, 2)) JOIN firms USING (firm) WHERE k <= 5) GROUP BY 1"""))
def answer_context(d: Domain):
    """For each office a text block of its five most awarded firms."""
    counted = d.focus.groupBy("office", "firm").agg(F.count("*").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("office").orderBy(F.desc("n"), "firm"))).where("k <= 5").join(d.firms.select("firm", "name"), "firm")
    line = F.concat(F.lit("- "), "name", F.lit(" ("), F.col("n").cast("string"), F.lit(" awards)"))
    listed = top.groupBy("office").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("x"))
    return listed.select("office", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("context"))


@query(oracle("""SELECT p_partkey AS id, CASE WHEN NOT contains(lower(p_name), '12') AND contains(lower(p_brand), '12') THEN p_brand END AS reason FROM part WHERE contains(lower(p_name || ' ' || p_brand), '12')"""))
def search_reasons(d: Domain, word: str = "12"):
    """The alias that made an entity match, where its label did not."""
    p = d.table("part")
    hit = lambda c: fn.search_form(F.col(c)).contains(word)
    reason = F.when(~hit("p_name") & hit("p_brand"), F.col("p_brand"))
    return p.where(hit("p_name") | hit("p_brand")).select(F.col("p_partkey").alias("id"), reason.alias("reason"))


@query(oracle("""SELECT ref, CASE WHEN ref % 3 = 0 THEN office WHEN ref % 3 = 1 THEN category ELSE CAST(ref AS VARCHAR) END AS label, CASE status WHEN 'F' THEN 'Contract' WHEN 'O' THEN 'Agency' ELSE 'Person' END AS kind FROM contracts"""))
def node_labels(d: Domain):
    """A node's label by name, title or reference; unknown kinds count as persons."""
    name, title = F.when(F.col("ref") % 3 == 0, F.col("office")), F.when(F.col("ref") % 3 == 1, F.col("category"))
    kinds = F.create_map(F.lit("F"), F.lit("Contract"), F.lit("O"), F.lit("Agency"))
    return d.contracts.select("ref", F.coalesce(name, title, F.col("ref").cast("string")).alias("label"), F.coalesce(kinds[F.col("status")], F.lit("Person")).alias("kind"))


@query(oracle("""SELECT person AS id, 'Person ' || person AS name, coalesce(CASE WHEN person % 2 = 0 THEN position END, 'member') AS position, province, strftime(term_start, '%Y-%m-%d') AS term_start FROM officials"""))
def members_projected(d: Domain):
    """Officials under their normal names, whichever of two headers a source uses."""
    raw = d.officials.select(F.col("person").alias("id"), F.concat(F.lit("Person "), F.col("person").cast("string")).alias("full_name"), F.when(F.col("person") % 2 == 0, F.col("position")).alias("position"), "province", "term_start")
    return raw.select("id", F.coalesce("full_name").alias("name"), F.coalesce("position", F.lit("member")).alias("position"), "province", F.date_format("term_start", "yyyy-MM-dd").alias("term_start"))


@query()
def node2vec_ties(d: Domain):
    """Pairs of large firms without a joint award that random-walk vectors place near each other.

    Walks run over firms, offices and joint awards; each pair comes with its Adamic-Adar score over common
    partners and offices, and the number of offices that both have worked for.
    """
    d.keep("focus")
    e = settled(focus_pairs(d), "tie-pairs").select("src", "dst", "weight")
    held = d.focus.join(d.places.select("office", "nation_key"), "office").groupBy("firm", "nation_key").agg(F.count("*").cast("double").alias("weight"))
    walked = e.unionByName(held.select(F.col("firm").alias("src"), (-1 - F.col("nation_key").cast("long")).alias("dst"), "weight"))
    big = settled(big_firms(d), "big-firms")
    offices = held.join(big, "firm", "left_semi").select(F.lit(0).alias("grp"), F.col("nation_key").alias("item"), F.col("firm").alias("member"), F.lit(1.0).alias("x"), F.lit(1.0).alias("u"))
    joint = e.join(big.withColumnRenamed("firm", "src"), "src", "left_semi").join(big.withColumnRenamed("firm", "dst"), "dst", "left_semi").select(F.lit(0).alias("grp"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("since"))
    vectors = embed.node_vectors(walks.random_walks(walked))
    found = settled(embed.predicted_ties(vectors, offices, joint), "predicted-ties")
    scores = graph.adamic_adar(walked, found.select("a", "b")).select("a", "b", F.col("score").alias("adamic_adar"))
    return found.select("a", "b", "score", F.col("shared").alias("shared_offices")).join(scores, ["a", "b"], "left")


@query()
def rewired_shared_offices(d: Domain, replicates: int = 8):
    """Pairs that share an office, observed and in graphs with the same degrees."""
    held = d.focus.select(F.col("firm").alias("left"), F.col("office").alias("right")).distinct()
    seen = held.select(F.lit(0).cast("long").alias("replicate"), "left", "right").unionByName(embed.rewired(held, replicates))
    return sets.meeting_members(seen, "replicate", "left", "right")
