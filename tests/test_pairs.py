"""Band joins, like sets and triangles against plain Python."""

import collections
import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from awardlens.operators import bands, flags, graph
from awardlens.operators.sets import like_sets


def award_rows(seed, n):
    rng = random.Random(seed)
    day = datetime.date(2020, 1, 1)
    return [(rng.choice("xy"), i, day + datetime.timedelta(rng.randrange(-40, 200)) if rng.random() > 0.1 else None, float(rng.choice([10, 19, 20, 21, 40, 41, 80, 7]))) for i in range(n)]


@pytest.mark.parametrize("days", [1, 7, 30])
def test_band_joins_match_all_pairs(spark, days):
    rows = award_rows(days, 250)
    df = spark.createDataFrame(rows, "office string, ref long, award_date date, amount double")
    dated = [r for r in rows if r[2]]
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(dated, 2) if a[0] == b[0] and abs((a[2] - b[2]).days) <= days}
    got = [(r.office, r.ref_a, r.ref_b) for r in bands.near_pairs(df, ["office"], days).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    clusters = {}
    for a in dated:
        near = [b for b in dated if b[0] == a[0] and (b[2], b[1]) >= (a[2], a[1]) and (b[2] - a[2]).days <= days and 0.5 * a[3] <= b[3] <= 2 * a[3]]
        clusters[(a[0], a[1])] = (len(near), sum(b[3] for b in near))
    assert {(r.office, r.anchor): (r.n, r.val) for r in bands.clusters_after(df, ["office"], days).collect()} == clusters


def test_undated_awards_are_grouped_without_dates(spark):
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([("o", 1, 1, None, 80.0), ("o", 1, 2, day, 90.0), ("o", 2, 3, None, 80.0), ("o", 1, 4, day, 10.0)], "office string, firm long, ref long, award_date date, amount double")
    assert {(r.ref, r.n, r.combined) for r in flags.splitting_undated(df, 100).collect()} == {(1, 2, 170.0), (2, 2, 170.0)}


@pytest.mark.parametrize(("shared", "jaccard"), [(1, 0.0), (3, 0.0), (2, 0.6), (4, 0.9)])
def test_like_sets_match_all_pairs(spark, shared, jaccard):
    rng = random.Random(7)
    sets = {m: frozenset(rng.sample(range(12), rng.choice([1, 3, 5, 11, 12]))) for m in range(60)}
    held = [(m, f"i{x}") for m, s in sets.items() for x in s]
    df = spark.createDataFrame(held + held[:20], "firm long, office string")
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= shared and len(sets[a] & sets[b]) >= jaccard * len(sets[a] | sets[b])}
    got = [tuple(r) for r in like_sets(df, "firm", "office", shared, jaccard).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_triangles_of_hubs_are_found_once(spark):
    rng = random.Random(3)
    edges = {(0, i) for i in range(1, 40)} | {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)}
    around = collections.defaultdict(set)
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    want = {(a, b, c) for a, b in edges for c in around[a] & around[b] if b < c}
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges] + [(5, 5), (0, 1)], "src long, dst long")
    got = [tuple(r) for r in graph.triangles(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_entities_with_a_flag_of_a_severity_carry_all_their_flags(spark):
    rows = [("a", "critical", "firm", "1"), ("b", "high", "firm", "1"), ("b", "high", "firm", "2"), ("c", "odd", "firm", "2")]
    df = spark.createDataFrame(rows, "flag string, severity string, entity_type string, entity_id string").withColumns({"n": F.lit(1), "val": F.lit(1.0)})
    assert [tuple(r) for r in flags.flagged_entities(df, "critical").collect()] == [("firm", "1", 7, 2, "a,b")]
    assert {(r.entity_id, r.risk_score) for r in flags.flagged_entities(df).collect()} == {("1", 7), ("2", 4)}
