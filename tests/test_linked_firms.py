"""Firms linked by addresses and directors against plain Python, and without a row for every pair of directors."""

import itertools
import random

import pytest

from awardlens.operators import flags, sets


@pytest.mark.parametrize("size", [3, 512])
def test_shell_network_counts_shared_directors_of_pairs_at_common_addresses(spark, size):
    rng = random.Random(3)
    at = {f: set(rng.sample("ABCDE", rng.choice([1, 1, 2, 3]))) for f in range(40)}
    led = {f: set(rng.sample(range(9), rng.choice([1, 2, 4]))) for f in range(40) if f % 7}
    addresses = spark.createDataFrame([(f, x) for f, xs in at.items() for x in xs] * 2, "firm long, address string")
    directors = spark.createDataFrame([(f, x) for f, xs in led.items() for x in xs] * 2, "firm long, director int")
    got = sorted((r.entity_id, r.n, r.val) for r in flags.shell_network(addresses, directors, size).collect())
    assert got == sorted((str(a), b, float(len(led.get(a, set()) & led.get(b, set())))) for a, b in itertools.combinations(range(40), 2) if at[a] & at[b])


def test_phoenix_counts_listed_firms_once_and_makes_no_pairs(spark):
    rng = random.Random(4)
    led = {f: set(rng.sample(range(9), rng.choice([1, 2, 4]))) for f in range(60)}
    bad = {f for f in led if f % 4 == 0}
    rows = spark.createDataFrame([(x, f) for f, xs in led.items() for x in xs] * 2, "director int, firm long")
    listed = spark.createDataFrame([(f,) for f in bad] * 2, "firm long")
    got = {(int(r.entity_id), r.n) for r in flags.phoenix(rows, "director", listed).collect()}
    want = {f: sum(bool(led[f] & led[b]) for b in bad) for f in led.keys() - bad}
    assert got == {(f, n) for f, n in want.items() if n}
    # one director of 60,000 firms, half of them listed: 900 million pairs, one pair of sets
    many = spark.range(60_000).selectExpr("id AS firm", "1 AS director")
    found = flags.phoenix(many, "director", many.where("firm % 2 = 0")).groupBy("n").count().collect()
    assert [tuple(r) for r in found] == [(30_000, 30_000)]


def test_members_that_share_an_item_are_counted_by_sets(spark):
    rng = random.Random(6)
    held = {m: set(rng.sample(range(8), rng.choice([1, 2, 3]))) for m in range(50)}
    rows = spark.createDataFrame([(m, x) for m, xs in held.items() for x in xs] * 2, "firm long, director int")
    got = {r.firm: (r.items, r.n) for r in sets.sharing_members(rows, "firm", "director").collect()}
    assert got == {m: (sorted(xs), sum(bool(xs & ys) for o, ys in held.items() if o != m)) for m, xs in held.items()}
    many = spark.range(60_000).selectExpr("id AS firm", "id % 2 AS director")
    assert [tuple(r) for r in sets.sharing_members(many, "firm", "director").groupBy("n").count().collect()] == [(29_999, 60_000)]
