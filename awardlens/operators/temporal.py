"""Yearly series, signals, link prediction over time, change points and motifs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.operators import blocks
from awardlens.operators.embed import swapped_edges, swapped_lists
from awardlens.operators.motifs import paired_years
from awardlens.operators.order import numbered
from awardlens.operators.rollups import co_pairs
from awardlens.operators.settle import settled


def split_value(awards: DataFrame) -> DataFrame:
    """Awards with `share`: the contract's amount divided among its firms."""
    n = awards.groupBy("ref").agg(F.count("*").alias("n_firms"))
    return awards.join(n, "ref").withColumn("share", F.col("amount").cast("double") / F.col("n_firms"))


def yearly_shares(awards: DataFrame, named: tuple[int, ...], top: int = 10) -> DataFrame:
    """Value by year with the shares of named firms, of entrants and of the `top` largest firms."""
    shares = split_value(awards).groupBy("year", "firm").agg(F.sum("share").alias("v"))
    first = awards.groupBy("firm").agg(F.min("year").alias("entered"))
    order = Window.partitionBy("year").orderBy(F.desc("v"), "firm")
    rows = shares.join(first, "firm").withColumn("k", F.row_number().over(order))
    total = F.sum("v")
    part = lambda c: F.round(100 * F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0.0)) / total, 4)
    return rows.groupBy("year").agg(
        F.round(total, 2).alias("val"),
        F.count("*").alias("n_firms"),
        part(F.col("firm").isin(list(named))).alias("named_pct"),
        part(F.col("entered") == F.col("year")).alias("entrant_pct"),
        part(F.col("k") <= top).alias("cr_pct"),
    )


def concentrated_by_year(awards: DataFrame, least: int, limit: float) -> DataFrame:
    """Active offices (so many contracts in the year) and those over a concentration limit."""
    size = awards.groupBy("year", "office").agg(F.count_distinct("ref").alias("c")).where(F.col("c") >= least)
    sums = awards.groupBy("year", "office", "firm").agg(F.sum("amount").cast("double").alias("v"))
    index = sums.groupBy("year", "office").agg((10000.0 * F.sum(F.col("v") * F.col("v")) / F.pow(F.sum("v"), 2)).alias("hhi"))
    joined = size.join(index, ["year", "office"])
    return joined.groupBy("year").agg(F.count("*").alias("active_offices"), F.count(F.when(F.col("hhi") > limit, 1)).alias("concentrated_offices"))


def cumulative_first_seen(first: DataFrame, years: DataFrame, name: str) -> DataFrame:
    """For each year the number of rows of first(year) up to it."""
    counted = first.groupBy("year").agg(F.count("*").alias("n"))
    all_years = years.join(counted, "year", "left").fillna(0, ["n"])
    return all_years.select("year", F.sum("n").over(Window.orderBy("year")).alias(name))  # one row per year


def _footprints(awards: DataFrame, least_n: int, least_value: float, jaccard: float) -> tuple[DataFrame, DataFrame, DataFrame, Callable]:
    """Offices of larger firms and their joint awards for `blocks`, each firm's number of offices and value, and a strip's pairs with sets so alike."""
    own = awards.groupBy("firm", "office").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    own = settled(own, "firm-offices")
    big = own.groupBy("firm").agg(F.sum("n").alias("n"), F.sum("v").cast("double").alias("v"), F.count("*").alias("size")).where((F.col("n") >= least_n) & (F.col("v") >= least_value))
    big = settled(big, "large-firms")
    held = own.join(big.select("firm"), "firm", "left_semi").select(F.lit(0).alias("grp"), F.col("office").alias("item"), F.col("firm").alias("member"), F.lit(1.0).alias("x"), F.lit(1.0).alias("u"))
    joint = co_pairs(awards.join(big.select("firm"), "firm", "left_semi").select("ref", "firm")).select(F.lit(0).alias("grp"), "a", "b", F.lit(0).alias("since")).distinct()

    def alike(s: blocks.Strip) -> tuple[np.ndarray, np.ndarray]:
        size_a, size_b = s.own(0)
        likeness = s.common / np.maximum(size_a + size_b - s.common, 1)
        return likeness, s.found & (likeness >= jaccard - 1e-9)

    return held, joint, big.select(F.col("firm").alias("member"), F.array(F.col("size").cast("double"), "v").alias("own")), alike


def footprints(awards: DataFrame, least_n: int, least_value: float, shared: int, jaccard: float) -> DataFrame:
    """Pairs of larger firms with like sets of offices and no joint award.

    Pairs are made in blocks of firms, which know the firms' values and leave out those with a joint award or unlike sets.
    """
    held, joint, own, alike = _footprints(awards, least_n, least_value, jaccard)

    def make(strips: Iterator[blocks.Strip]) -> Iterator[pd.DataFrame]:
        for s in strips:
            likeness, found = alike(s)
            r, c, a, b = s.at(found)
            va, vb = s.own(1)
            yield pd.DataFrame({"a": a, "b": b, "shared": s.common[r, c], "jaccard": blocks.rounded(likeness[r, c], 6), "val": blocks.rounded(va[r, 0] + vb[0, c], 2)})

    return blocks.found_pairs(held, joint, make, "a long, b long, shared long, jaccard double, val double", shared, own=own)


def best_footprints(awards: DataFrame, least_n: int, least_value: float, shared: int, jaccard: float, n: int) -> DataFrame:
    """The n pairs of `footprints` with most value, and the number of all; each task keeps its n best and counts the others."""
    held, joint, own, alike = _footprints(awards, least_n, least_value, jaccard)

    def rate(s: blocks.Strip) -> tuple[np.ndarray, np.ndarray]:
        va, vb = s.own(1)
        return blocks.rounded(va + vb, 2), alike(s)[1]

    best = blocks.best_pairs(held, joint, rate, n, shared, own)
    size = lambda c: own.select(F.col("member").alias(c), F.col("own")[0].alias(f"size_{c}"))
    sized = F.broadcast(best).join(size("a"), "a").join(size("b"), "b")  # n rows
    likeness = F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6)
    return sized.select("a", "b", F.col("common").alias("shared"), likeness.alias("jaccard"), F.col("rank").alias("val"), "n_all").orderBy(F.desc("val"), "a", "b")


def alternation(rows: DataFrame, least_awards: int = 3, least_years: int = 4) -> DataFrame:
    """Offices whose yearly top holder alternates between exactly two holders: rows have office, year, holder, amount."""
    sums = rows.groupBy("office", "year", "holder").agg(F.sum("amount").alias("v"), F.count("*").alias("n"))
    best = sums.groupBy("office", "year").agg(F.sum("n").alias("n"), F.max_by("holder", F.struct("v", -F.col("holder"))).alias("holder")).where(F.col("n") >= least_awards)
    order = Window.partitionBy("office").orderBy("year")
    moved = best.withColumn("moved", (F.col("holder") != F.lag("holder").over(order)).cast("int"))
    found = moved.groupBy("office").agg(F.count("*").alias("n_years"), F.count_distinct("holder").alias("n_holders"), F.coalesce(F.sum("moved"), F.lit(0)).alias("switches"))
    return found.where((F.col("n_years") >= least_years) & (F.col("n_holders") == 2) & (F.col("switches") >= 2))


def entrants(rows: DataFrame, since: int, least_value: float) -> DataFrame:
    """Firms first seen in `since` or later with much value in their first two years."""
    first = rows.groupBy("firm").agg(F.min("year").alias("first_year")).where(F.col("first_year") >= since)
    early = rows.join(first, "firm").where(F.col("year") <= F.col("first_year") + 1)
    return early.groupBy("firm", "first_year").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("val")).where(F.col("val") >= least_value)


def pettitt(series: DataFrame) -> DataFrame:
    """Pettitt's change point of each series(metric, year, x): year, p-value and means around it.

    A series has one row per period, so its self-join is small for any number of series.
    """
    ordered = series.withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy("year")))
    n = ordered.groupBy("metric").agg(F.count("*").alias("n"))
    cuts = ordered.join(n, "metric").where(F.col("i") < F.col("n")).select("metric", F.col("i").alias("t"), F.col("year").alias("cut"), "n")
    before = ordered.select("metric", F.col("i").alias("p"), F.col("x").alias("xi"))
    after = ordered.select("metric", F.col("i").alias("q"), F.col("x").alias("xj"))
    signs = cuts.join(before, "metric").where(F.col("p") <= F.col("t")).join(after, "metric").where(F.col("q") > F.col("t"))
    u = signs.groupBy("metric", "t", "cut", "n").agg(F.sum(F.signum(F.col("xi") - F.col("xj"))).alias("u"))
    best = u.groupBy("metric", "n").agg(F.max_by(F.struct("t", "cut", "u"), F.struct(F.abs("u"), -F.col("t"))).alias("b"))
    k = F.abs(F.col("b.u"))
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / (F.pow("n", 3) + F.pow("n", 2))))
    found = best.select("metric", "n", F.col("b.t").alias("t"), F.col("b.cut").alias("change_after"), k.alias("k"), F.round(p, 4).alias("p_value"))
    means = ordered.join(found, "metric").groupBy("metric", "change_after", "p_value").agg(F.round(F.avg(F.when(F.col("i") <= F.col("t"), F.col("x"))), 4).alias("before_mean"), F.round(F.avg(F.when(F.col("i") > F.col("t"), F.col("x"))), 4).alias("after_mean"))
    return means


#: ln 2 / 2: shared offices lose half their weight in two years.
HALF_LIFE = 0.34657359027997264


def known_by(awards: DataFrame, cuts: list[int]) -> DataFrame:
    """Firms' offices by each cut year, with the last year of an award."""
    spine = F.broadcast(awards.sparkSession.createDataFrame([(c,) for c in cuts], "cut int"))
    return awards.join(spine, F.col("year") <= F.col("cut")).groupBy("cut", "firm", "office").agg(F.max("year").alias("last"))


def link_rows(awards: DataFrame, big: DataFrame, cuts: list[int]) -> tuple[DataFrame, DataFrame]:
    """Big firms' offices by cut year with their weights, and the first joint year of their pairs, as rows for `blocks`."""
    known = settled(known_by(awards, cuts), "known-offices")
    crowd = known.groupBy("cut", "office").agg(F.count("*").alias("d"))
    held = known.join(big, "firm", "left_semi").join(crowd, ["cut", "office"])
    fresh = F.exp(-HALF_LIFE * (F.col("cut") - F.col("last")))
    rows = held.select(F.col("cut").alias("grp"), F.col("office").alias("item"), F.col("firm").alias("member"), fresh.alias("x"), F.when(F.col("d") > 1, 1 / F.log(1.0 + F.col("d"))).otherwise(F.lit(1.0)).alias("u"))
    joint = co_pairs(awards.join(big, "firm", "left_semi").select("ref", "firm", "year"), carry=("year",)).groupBy("a", "b").agg(F.min("year").alias("since"))
    return rows, joint.withColumn("grp", F.explode(F.array(*map(F.lit, cuts))))


def link_candidates(awards: DataFrame, big: DataFrame, cuts: list[int], only_positive: bool = False) -> DataFrame:
    """Pairs of big firms that share an office by a cut year and have no joint award by then.

    Gives cut, a, b, a decayed Adamic-Adar score over shared offices, and whether their first joint award
    falls in the following year. All cuts run in one plan, pairs are made in blocks of firms.
    """
    rows = blocks.open_pairs(*link_rows(awards, big, cuts), only_positive)
    return rows.select(F.col("grp").cast("int").alias("cut"), "a", "b", F.round("score", 9).alias("score"), F.col("next").alias("positive"))


def link_auc(awards: DataFrame, big: DataFrame, cuts: list[int]) -> DataFrame:
    """AUC by cut of the candidates' scores; only those of positive ones leave the tasks that make them."""
    return blocks.open_auc(*link_rows(awards, big, cuts)).withColumn("cut", F.col("grp").cast("int")).select("cut", "n", "n_pos", "auc")


def auc(rows: DataFrame, by: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Rank-based ROC-AUC with average ranks for ties, from counts per distinct score."""
    ties = rows.groupBy(*by, score).agg(F.count("*").alias("t"), F.sum(F.col(positive).cast("long")).alias("p"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("t").over(below), F.lit(0)) + (F.col("t") + 1) / 2
    sums = ties.withColumn("r", rank * F.col("p")).groupBy(*by).agg(F.sum("r").alias("r"), F.sum("p").alias("n_pos"), F.sum("t").alias("n"))
    n_neg = F.col("n") - F.col("n_pos")
    value = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * n_neg)
    return sums.where((F.col("n_pos") > 0) & (n_neg > 0)).select(*by, "n", "n_pos", F.round(value, 6).alias("auc"))


def drawn_places(n: int, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the places 1 to n, each such set as likely as any other: draws until k differ, which is short where k is at most n / 2."""
    found = np.zeros(0, dtype=np.int64)
    while len(found) < k:
        found = np.union1d(found, rng.integers(1, n + 1, k - len(found)))
    return found


def permutation_nulls(rows: DataFrame, times: int, seed: int = 42) -> DataFrame:
    """AUC by cut of `times` random orders of all rows.

    In a random order the positive rows stand at a random set of places, and the AUC depends on that set alone; so
    a replicate draws their places, and no row is repeated for it.
    """
    sizes = settled(rows.groupBy("cut").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("n_pos")).where("n_pos > 0 AND n_pos < n"), "null-sizes")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                n, k = int(r.n), int(r.n_pos)
                fewer = min(k, n - k)
                places = float(drawn_places(n, fewer, np.random.default_rng([seed, int(r.cut), int(r.replicate)])).sum())
                ranks = places if fewer == k else n * (n + 1) / 2 - places
                yield pd.DataFrame({"cut": [r.cut], "replicate": [r.replicate], "n": [n], "n_pos": [k], "auc": [round((ranks - k * (k + 1) / 2) / (k * (n - k)), 6)]})

    replicates = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(times)))).repartition(64, "cut", "replicate")
    return replicates.mapInPandas(run, "cut int, replicate int, n long, n_pos long, auc double")


def rewired_nulls(candidates: DataFrame, known: DataFrame, times: int, rounds: int = 10) -> DataFrame:
    """AUC by cut and replicate of the candidates' scores on graphs with the same degrees.

    `known` has the scored firms' offices (cut, firm, office, last). All cuts and replicates are rewired together.
    """
    known = settled(known.select("cut", "firm", "office", "last"), "known-offices")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times).cast("long")))
    graphs = known.withColumn("k", number).select((F.col("cut") * F.lit(times).cast("long") + F.col("k")).alias("replicate"), F.col("firm").alias("left"), F.col("office").alias("right"))
    place = F.col("replicate") - 1
    moved = swapped_edges(graphs, rounds).select(F.floor(place / times).cast("int").alias("cut"), (place % times + 1).alias("replicate"), F.col("left").alias("firm"), F.col("right").alias("office"))
    return rewired_auc(candidates, known, moved, times)


def rewired_auc(candidates: DataFrame, known: DataFrame, graphs: DataFrame, times: int) -> DataFrame:  # noqa: ARG001
    """AUC by (cut, replicate) of graphs(cut, replicate, firm, office).

    A firm's new office counts as fresh, an old one keeps its last year; a candidate without a shared office scores zero.
    """
    dated = graphs.join(known, ["cut", "firm", "office"], "left")
    crowd = graphs.groupBy("cut", "replicate", "office").agg(F.count("*").alias("d"))
    w = F.exp(-HALF_LIFE * (F.col("cut") - F.coalesce("last", "cut")))
    u = F.when(F.col("d") > 1, 1 / F.log(1.0 + F.col("d"))).otherwise(F.lit(1.0))
    rows = dated.join(crowd, ["cut", "replicate", "office"]).select(F.col("cut").alias("grp"), F.col("replicate").alias("rep"), F.col("office").alias("item"), F.col("firm").alias("member"), w.alias("x"), u.alias("u"))
    given = candidates.select(F.col("cut").alias("grp"), "a", "b", F.col("positive").alias("next"))
    return blocks.given_auc(given, rows).select(F.col("grp").cast("int").alias("cut"), F.col("rep").alias("replicate"), "auc")


def rewired_open_nulls(awards: DataFrame, big: DataFrame, cuts: list[int], times: int, rounds: int = 10) -> DataFrame:
    """AUC by cut and replicate of the open pairs of big firms (`link_rows`) on graphs with the same degrees, which are not written as pairs.

    All cuts and replicates are rewired together. Scores are those of `rewired_auc`; degrees of offices stay, and so do their weights.
    """
    held, links = (settled(x, "null-parts") for x in link_rows(awards, big, cuts))
    known = settled(known_by(awards.join(big, "firm", "left_semi"), cuts), "known-offices")
    offices = settled(numbered(known.select("office").distinct(), [F.col("office")], "n").select("office", (F.col("n") - 1).cast("long").alias("item")), "null-offices")
    own = settled(known.join(offices, "office").groupBy("cut", "firm").agg(F.sort_array(F.collect_list("item")).alias("rights"), F.map_from_entries(F.collect_list(F.struct("item", "last"))).alias("last")), "null-lists")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times).cast("long")))
    graphs = own.withColumn("k", number).select((F.col("cut") * F.lit(times).cast("long") + F.col("k")).alias("replicate"), F.col("firm").alias("left"), "rights")
    place = F.col("replicate") - 1
    moved = swapped_lists(graphs, rounds).select(F.floor(place / times).cast("int").alias("cut"), (place % times + 1).alias("rep"), F.col("left").alias("firm"), "rights")
    since = F.transform("rights", lambda r: F.exp(-HALF_LIFE * (F.col("cut") - F.coalesce(F.col("last")[r], F.col("cut")))))
    dated = moved.join(own.select("cut", "firm", "last"), ["cut", "firm"]).select(F.col("cut").cast("long").alias("grp"), "rep", F.col("firm").alias("member"), F.col("rights").alias("items"), since.alias("xs"))
    degree = known.groupBy("cut", "office").agg(F.count("*").alias("d")).join(offices, "office")
    weight = F.when(F.col("d") > 1, 1 / F.log(1.0 + F.col("d"))).otherwise(F.lit(1.0))
    weights = degree.groupBy(F.col("cut").cast("long").alias("grp")).agg(F.map_from_entries(F.collect_list(F.struct("item", weight))).alias("us"))
    found = blocks.null_auc(held, links, dated, weights)
    return found.select(F.col("grp").cast("int").alias("cut"), F.col("rep").alias("replicate"), "auc")


def motifs(awards: DataFrame, big: DataFrame, tasks: int, least: int = 3) -> DataFrame:
    """Joint pairs of big firms: is their first joint award before, after or around the median year of their shared offices' awards?"""
    own = settled(awards.join(big, "firm", "left_semi").select("ref", "firm", "office", "year"), "big-awards")
    joint = co_pairs(own.select("ref", "firm", "year").repartition(tasks, "ref"), carry=("year",)).repartition(tasks, "a", "b").groupBy("a", "b").agg(F.min("year").alias("first_joint"))
    found = paired_years(joint, own.select("firm", "office", "year").distinct(), tasks).where(F.col("n") >= least)
    kind = F.when(F.col("first_joint") < F.col("mid") - 0.5, "before").when(F.col("first_joint") > F.col("mid") + 0.5, "after").otherwise("concurrent")
    return found.select("a", "b", "first_joint", "n", "mid", kind.alias("motif"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows: labels(period, x, y)."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cells = labels.groupBy("period", "x", "y").agg(F.count("*").alias("c")).groupBy("period").agg(pairs(F.col("c")).alias("both"), F.sum("c").alias("n"))
    left = labels.groupBy("period", "x").agg(F.count("*").alias("c")).groupBy("period").agg(pairs(F.col("c")).alias("l"))
    right = labels.groupBy("period", "y").agg(F.count("*").alias("c")).groupBy("period").agg(pairs(F.col("c")).alias("r"))
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("l") * F.col("r") / all_pairs
    index = (F.col("both") - expected) / ((F.col("l") + F.col("r")) / 2 - expected)
    return cells.join(left, "period").join(right, "period").select("period", "n", F.round(F.when((F.col("l") + F.col("r")) / 2 == expected, 1.0).otherwise(index), 6).alias("ari"))
