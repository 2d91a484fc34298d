"""Yearly series, signals, link prediction and change points on the mapped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators import temporal as op
from awardlens.operators.settle import settled
from awardlens.plans.network import PAIRS, focus_pairs
from awardlens.plans.registry import registry
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()
NAMED = (1, 2, 3, 5, 8)


@query(oracle("""SELECT year, round(sum(v), 2) AS val, count(*) AS n_firms, round(100 * coalesce(sum(v) FILTER (firm IN (1, 2, 3, 5, 8)), 0) / sum(v), 4) AS named_pct,
 round(100 * coalesce(sum(v) FILTER (entered = year), 0) / sum(v), 4) AS entrant_pct, round(100 * coalesce(sum(v) FILTER (k <= 10), 0) / sum(v), 4) AS cr_pct FROM
 (SELECT *, row_number() OVER (PARTITION BY year ORDER BY v DESC, firm) AS k FROM (SELECT year, firm, sum(CAST(amount AS DOUBLE) / n) AS v FROM focus JOIN (SELECT ref, count(*) AS n FROM focus GROUP BY 1) USING (ref) GROUP BY 1, 2)
 JOIN (SELECT firm, min(year) AS entered FROM focus GROUP BY 1) USING (firm)) GROUP BY year"""))
def yearly_shares(d: Domain):
    return op.yearly_shares(d.focus, NAMED)


@query(oracle("""SELECT year, count(*) AS active_offices, count(*) FILTER (hhi > 400) AS concentrated_offices FROM (SELECT year, office, count(DISTINCT ref) AS c FROM focus GROUP BY 1, 2) JOIN
 (SELECT year, office, 10000.0 * sum(v * v) / (sum(v) * sum(v)) AS hhi FROM (SELECT year, office, firm, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (year, office) WHERE c >= 5 GROUP BY year"""))
def concentrated_by_year(d: Domain):
    return op.concentrated_by_year(d.focus, 5, 400)


@query(oracle("""SELECT y.year, CAST((SELECT count(*) FROM pairs p WHERE p.year <= y.year) AS BIGINT) AS pairs_cum, CAST((SELECT count(*) FROM (SELECT id, min(year) AS f FROM (SELECT src AS id, year FROM pairs UNION ALL SELECT dst, year FROM pairs) GROUP BY 1) WHERE f <= y.year) AS BIGINT) AS firms_cum
 FROM (SELECT DISTINCT year FROM contracts) y""", PAIRS))
def jv_growth(d: Domain):
    """Joint pairs and firms in them, cumulated by year."""
    pairs = focus_pairs(d)
    years = d.contracts.select("year").distinct()
    ends = pairs.select(F.col("src").alias("id"), "year").unionAll(pairs.select(F.col("dst").alias("id"), "year"))
    firms = ends.groupBy("id").agg(F.min("year").alias("year"))
    return op.cumulative_first_seen(pairs, years, "pairs_cum").join(op.cumulative_first_seen(firms, years, "firms_cum"), "year")


FOOT = """big AS (SELECT firm, count(DISTINCT office) AS d, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1 HAVING count(*) >= 10 AND sum(amount) >= 500000), held AS (SELECT DISTINCT firm, office FROM focus SEMI JOIN big USING (firm)),
feet AS (SELECT a, b, shared, round(shared / (x.d + y.d - shared), 6) AS jaccard, round(x.v + y.v, 2) AS val FROM (SELECT x.firm AS a, y.firm AS b, count(*) AS shared FROM held x JOIN held y ON x.office = y.office AND x.firm < y.firm GROUP BY 1, 2) s
 JOIN big x ON x.firm = a JOIN big y ON y.firm = b WHERE shared >= 4 AND shared / (x.d + y.d - shared) >= 0.6 AND NOT EXISTS (SELECT 1 FROM focus p JOIN focus q ON p.ref = q.ref WHERE p.firm = a AND q.firm = b))"""


#: Focus awards and value of firms with a footprint, offices that two share, and the likeness of their sets.
FEET = (10, 500_000, 4, 0.6)


@query(oracle("SELECT * FROM feet", FOOT))
def footprint_pairs(d: Domain):
    d.keep("focus")
    return op.footprints(d.focus, *FEET)


@query(oracle("""SELECT office, count(*) AS n_years, count(DISTINCT holder) AS n_holders, CAST(coalesce(sum(CASE WHEN holder <> p THEN 1 ELSE 0 END), 0) AS BIGINT) AS switches FROM
 (SELECT *, lag(holder) OVER (PARTITION BY office ORDER BY year) AS p FROM (SELECT office, year, sum(n) AS n, max_by(holder, (v, -holder)) AS holder FROM
 (SELECT office, year, firm % 3 AS holder, sum(amount) AS v, count(*) AS n FROM focus GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(n) >= 3)) GROUP BY office HAVING count(*) >= 4 AND count(DISTINCT holder) = 2 AND sum(CASE WHEN holder <> p THEN 1 ELSE 0 END) >= 2"""))
def alternation(d: Domain):
    """Holders are three consortia of firms."""
    return op.alternation(d.focus.withColumn("holder", F.col("firm") % 3))


@query(oracle("""SELECT firm, first_year, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS val FROM rows_ JOIN (SELECT firm, min(year) AS first_year FROM rows_ GROUP BY 1 HAVING min(year) >= 1996) USING (firm) WHERE year <= first_year + 1 GROUP BY 1, 2 HAVING sum(amount) >= 50000""",
 "rows_ AS (SELECT l_partkey AS firm, CAST(year(l_shipdate) AS INT) AS year, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem)"))
def sudden_entrants(d: Domain):
    """Parts stand for firms, since suppliers all start in the first year."""
    rows = d.table("lineitem").select(F.col("l_partkey").alias("firm"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return op.entrants(rows, 1996, 50_000)


def _series(d: Domain) -> DataFrame:
    by = d.contracts.groupBy(F.col("category").alias("metric"), "year").agg(F.sum("amount").cast("double").alias("x"))
    return by


@query(oracle("""SELECT metric, change_after, p_value, round(avg(x) FILTER (i <= t), 4) AS before_mean, round(avg(x) FILTER (i > t), 4) AS after_mean FROM s JOIN
 (SELECT metric, t, cut AS change_after, round(least(1.0, 2 * exp(-6 * abs(u) * abs(u) / (pow(n, 3) + pow(n, 2)))), 4) AS p_value FROM
  (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(u) DESC, t) AS k FROM
   (SELECT c.metric, c.i AS t, c.year AS cut, (SELECT count(*) FROM s z WHERE z.metric = c.metric) AS n, sum(sign(p.x - q.x)) AS u FROM s c JOIN s p ON p.metric = c.metric AND p.i <= c.i JOIN s q ON q.metric = c.metric AND q.i > c.i GROUP BY 1, 2, 3)) WHERE k = 1) USING (metric)
 GROUP BY 1, 2, 3""", """s AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY year) AS i FROM (SELECT category AS metric, year, CAST(sum(amount) AS DOUBLE) AS x FROM contracts GROUP BY 1, 2))"""))
def pettitt_change_points(d: Domain):
    return op.pettitt(_series(d))


#: Value of focus awards from which a firm counts as large.
LARGE = 32_000_000
CUTS = [1996, 1997, 1998]


def big_firms(d: Domain) -> DataFrame:
    """Every firm whose focus awards reach the value limit."""
    return d.focus.groupBy("firm").agg(F.sum("amount").alias("v")).where(F.col("v") >= LARGE).select("firm")


_LINK = """big AS (SELECT firm FROM focus GROUP BY 1 HAVING sum(amount) >= 32000000),
small AS (SELECT * FROM focus), cuts AS (SELECT unnest([1996, 1997, 1998]) AS cut),
known AS (SELECT cut, firm, office, max(year) AS last FROM small JOIN cuts ON year <= cut GROUP BY 1, 2, 3),
crowd AS (SELECT cut, office, count(*) AS d FROM known GROUP BY 1, 2),
held AS (SELECT k.cut, k.office, k.firm, exp(-0.34657359027997264 * (k.cut - last)) AS w, CASE WHEN d > 1 THEN 1 / ln(1.0 + d) ELSE 1.0 END AS u FROM known k JOIN big USING (firm) JOIN crowd c ON k.cut = c.cut AND k.office = c.office),
joint AS (SELECT x.firm AS a, y.firm AS b, min(x.year) AS f FROM small x JOIN small y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2),
cand AS (SELECT s.*, coalesce(f = cut + 1, false) AS positive FROM (SELECT x.cut, x.firm AS a, y.firm AS b, round(sum(x.u * x.w * y.w), 9) AS score FROM held x JOIN held y ON x.cut = y.cut AND x.office = y.office AND x.firm < y.firm GROUP BY 1, 2, 3) s
 LEFT JOIN joint j ON s.a = j.a AND s.b = j.b WHERE f IS NULL OR f > cut)"""


def link_scores(d: Domain) -> DataFrame:
    d.keep("focus")
    return op.link_auc(d.focus, big_firms(d), CUTS)


@query(oracle("""SELECT CAST(cut AS INT) AS cut, CAST(n AS BIGINT) AS n, CAST(np AS BIGINT) AS n_pos, round((r - np * (np + 1) / 2) / (np * (n - np)), 6) AS auc FROM (SELECT cut, count(*) AS n, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS np, sum(CASE WHEN positive THEN rk ELSE 0 END) AS r FROM
 (SELECT *, rank() OVER (PARTITION BY cut ORDER BY score) + (count(*) OVER (PARTITION BY cut, score) - 1) / 2 AS rk FROM cand) GROUP BY cut) WHERE np > 0 AND n > np""", _LINK))
def temporal_link_auc(d: Domain):
    return link_scores(d)


@query(oracle("""SELECT count(*) AS n_years, round(avg(auc), 3) AS macro_auc FROM (SELECT (r - np * (np + 1) / 2) / (np * (n - np)) AS auc FROM (SELECT cut, count(*) AS n, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS np, sum(CASE WHEN positive THEN rk ELSE 0 END) AS r FROM
 (SELECT *, rank() OVER (PARTITION BY cut ORDER BY score) + (count(*) OVER (PARTITION BY cut, score) - 1) / 2 AS rk FROM cand) GROUP BY cut) WHERE np >= 2 AND n > np)""", _LINK))
def temporal_link_macro(d: Domain):
    """The mean AUC over the cuts that have two new ties or more."""
    return link_scores(d).where("n_pos >= 2").agg(F.count("*").alias("n_years"), F.round(F.avg("auc"), 3).alias("macro_auc"))


@query(oracle("SELECT CAST(cut AS INT) AS cut, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY score DESC, a, b) AS k FROM cand WHERE positive) WHERE k <= 5", _LINK))
def temporal_link_hits(d: Domain):
    """The five best-scored pairs of each cut that did form a tie in the next year."""
    order = Window.partitionBy("cut").orderBy(F.desc("score"), "a", "b")
    d.keep("focus")
    return op.link_candidates(d.focus, big_firms(d), CUTS, True).withColumn("k", F.row_number().over(order)).where("k <= 5").select("cut", "a", "b", "score")


@query()
def temporal_link_nulls(d: Domain, times: int = 500):
    """The share of random orders of all focus contracts' candidates that reach the observed AUC, by cut."""
    d.keep("focus")
    rows = op.link_candidates(d.focus, big_firms(d), CUTS)
    seen = link_scores(d).select("cut", F.col("auc").alias("observed"))
    return reached(op.permutation_nulls(rows, times).join(seen, "cut"))


@query()
def temporal_link_rewired(d: Domain, times: int = 120):
    """The share of graphs with the same degrees whose scores reach the observed AUC, by cut."""
    d.keep("focus")
    big = settled(big_firms(d), "big-firms")
    seen = op.link_auc(d.focus, big, CUTS).select("cut", F.col("auc").alias("observed"))
    return reached(op.rewired_open_nulls(d.focus, big, CUTS, times).join(seen, "cut"))


def reached(nulls: DataFrame) -> DataFrame:
    """By cut: how often a null's AUC is as high as the observed one (with one added), and the nulls' mean."""
    return nulls.groupBy("cut", "observed").agg(((F.count(F.when(F.col("auc") >= F.col("observed"), 1)) + 1) / (F.count("*") + 1)).alias("p_value"), F.avg("auc").alias("null_mean"))


@query(oracle("""SELECT a, b, first_joint, n, mid, CASE WHEN first_joint < mid - 0.5 THEN 'before' WHEN first_joint > mid + 0.5 THEN 'after' ELSE 'concurrent' END AS motif FROM
 (SELECT a, b, first_joint, count(*) AS n, median(year) AS mid FROM (SELECT DISTINCT a, b, first_joint, office, year FROM (SELECT j.a, j.b, f AS first_joint, x.office, unnest([x.year, y.year]) AS year FROM joint j JOIN held x ON x.firm = j.a JOIN held y ON y.firm = j.b AND y.office = x.office)) GROUP BY 1, 2, 3) WHERE n >= 3""",
 """big AS (SELECT firm FROM focus GROUP BY 1 HAVING sum(amount) >= 32000000), own AS (SELECT * FROM focus SEMI JOIN big USING (firm)),
 held AS (SELECT DISTINCT firm, office, year FROM own), joint AS (SELECT x.firm AS a, y.firm AS b, min(x.year) AS f FROM own x JOIN own y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2)"""))
def temporal_motifs(d: Domain):
    return op.motifs(d.focus, big_firms(d), d.tasks)


@query(oracle("""SELECT motif, a, b, first_joint, n, mid, CAST(k AS INT) AS rank, n_all FROM (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY n DESC, a, b) AS k, count(*) OVER (PARTITION BY motif) AS n_all FROM
 (SELECT a, b, first_joint, n, mid, CASE WHEN first_joint < mid - 0.5 THEN 'before' WHEN first_joint > mid + 0.5 THEN 'after' ELSE 'concurrent' END AS motif FROM
 (SELECT a, b, first_joint, count(*) AS n, median(year) AS mid FROM (SELECT DISTINCT a, b, first_joint, office, year FROM (SELECT j.a, j.b, f AS first_joint, x.office, unnest([x.year, y.year]) AS year FROM joint j JOIN held x ON x.firm = j.a JOIN held y ON y.firm = j.b AND y.office = x.office)) GROUP BY 1, 2, 3) WHERE n >= 3)) WHERE k <= 12""",
 """big AS (SELECT firm FROM focus GROUP BY 1 HAVING sum(amount) >= 32000000), own AS (SELECT * FROM focus SEMI JOIN big USING (firm)),
 held AS (SELECT DISTINCT firm, office, year FROM own), joint AS (SELECT x.firm AS a, y.firm AS b, min(x.year) AS f FROM own x JOIN own y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2)"""))
def motif_examples(d: Domain, top: int = 12):
    """How many pairs each motif has, and its twelve with most awards of shared offices."""
    found = settled(op.motifs(d.focus, big_firms(d), d.tasks), "motifs")
    order = Window.partitionBy("motif").orderBy(F.desc("n"), "a", "b")
    counts = found.groupBy("motif").agg(F.count("*").alias("n_all"))  # three rows
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(F.broadcast(counts), "motif").select("motif", "a", "b", "first_joint", "n", "mid", "rank", "n_all")


@query(oracle("""SELECT period, n, round(CASE WHEN (l + r) / 2 = l * r / (n * (n - 1) / 2) THEN 1.0 ELSE (b - l * r / (n * (n - 1) / 2)) / ((l + r) / 2 - l * r / (n * (n - 1) / 2)) END, 6) AS ari FROM
 (SELECT period, sum(c * (c - 1) / 2) AS b, CAST(sum(c) AS BIGINT) AS n FROM (SELECT period, x, y, count(*) AS c FROM t GROUP BY 1, 2, 3) GROUP BY 1) JOIN
 (SELECT period, sum(c * (c - 1) / 2) AS l FROM (SELECT period, x, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1) USING (period) JOIN
 (SELECT period, sum(c * (c - 1) / 2) AS r FROM (SELECT period, y, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1) USING (period)""",
 """y AS (SELECT year, firm, max_by(office, (v, office)) AS o FROM (SELECT year, firm, office, sum(amount) AS v FROM focus GROUP BY 1, 2, 3) GROUP BY 1, 2), t AS (SELECT q.year AS period, p.o AS x, q.o AS y FROM y p JOIN y q ON p.firm = q.firm AND q.year = p.year + 1)"""))
def adjusted_rand(d: Domain):
    """Likeness of consecutive years' groupings of firms by their main office."""
    sums = d.focus.groupBy("year", "firm", "office").agg(F.sum("amount").alias("v"))
    main = sums.groupBy("year", "firm").agg(F.max_by("office", F.struct("v", "office")).alias("o"))
    after = main.select((F.col("year") - 1).alias("year"), "firm", F.col("o").alias("y"), F.col("year").alias("period"))
    return op.adjusted_rand(main.withColumnRenamed("o", "x").join(after, ["year", "firm"]).select("period", "x", "y"))


@query(oracle("SELECT year, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS val FROM contracts GROUP BY 1"))
def coverage_by_year(d: Domain):
    return d.contracts.groupBy("year").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val"))


@query(oracle("SELECT firm, office, max(year) AS last_year FROM awards WHERE year <= 1998 GROUP BY 1, 2"))
def last_award_by(d: Domain, year: int = 1998):
    """Most recent award year up to a year, by firm and office."""
    return d.awards.where(F.col("year") <= year).groupBy("firm", "office").agg(F.max("year").alias("last_year"))


_BY_YEAR = """yp AS (SELECT x.year, x.firm AS src, y.firm AS dst, CAST(count(*) AS DOUBLE) AS weight FROM focus x JOIN focus y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2, 3), w AS (SELECT year, src, dst, weight FROM yp UNION ALL SELECT year, dst, src, weight FROM yp),
l0 AS (SELECT DISTINCT year, src AS id, src AS label FROM w), """ + ", ".join(f"l{k} AS (SELECT year, id, max_by(label, (v, -label)) AS label FROM (SELECT w.year, w.src AS id, l.label, sum(weight) AS v FROM w JOIN l{k - 1} l ON l.id = w.dst AND l.year = w.year GROUP BY 1, 2, 3) GROUP BY 1, 2)" for k in range(1, 4)) + """,
t AS (SELECT q.year AS period, p.label AS x, q.label AS y FROM l3 p JOIN l3 q ON p.id = q.id AND q.year = p.year + 1)"""


@query(oracle("""SELECT period, n, round(CASE WHEN (l + r) / 2 = l * r / (n * (n - 1) / 2) THEN 1.0 ELSE (b - l * r / (n * (n - 1) / 2)) / ((l + r) / 2 - l * r / (n * (n - 1) / 2)) END, 6) AS ari FROM
 (SELECT period, sum(c * (c - 1) / 2) AS b, CAST(sum(c) AS BIGINT) AS n FROM (SELECT period, x, y, count(*) AS c FROM t GROUP BY 1, 2, 3) GROUP BY 1) JOIN
 (SELECT period, sum(c * (c - 1) / 2) AS l FROM (SELECT period, x, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1) USING (period) JOIN
 (SELECT period, sum(c * (c - 1) / 2) AS r FROM (SELECT period, y, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1) USING (period)""", _BY_YEAR))
def communities_over_years(d: Domain):
    """Likeness of consecutive years' communities of joint awards; all years run as one graph."""
    from awardlens.operators import graph, rollups

    node = lambda c: F.col("year").cast("long") * F.lit(1 << 40) + F.col(c)
    pairs = rollups.co_pairs(d.focus, carry=("year",)).groupBy("year", "a", "b").agg(F.count("*").cast("double").alias("weight"))
    labels = graph.label_propagation(pairs.select(node("a").alias("src"), node("b").alias("dst"), "weight"), 3)
    named = labels.select(F.floor(F.col("id") / (1 << 40)).cast("int").alias("year"), (F.col("id") % (1 << 40)).alias("firm"), (F.col("label") % (1 << 40)).alias("label"))
    after = named.select((F.col("year") - 1).alias("year"), "firm", F.col("label").alias("y"), F.col("year").alias("period"))
    return op.adjusted_rand(named.withColumnRenamed("label", "x").join(after, ["year", "firm"]).select("period", "x", "y"))
