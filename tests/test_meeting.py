"""Counts of pairs by their sets, and cycles and triangles that meet in blocks, against plain Python."""

import collections
import itertools
import random

import pytest

from awardlens.operators import graph, sets, temporal


def drawn(seed, members, items, chance):
    rng = random.Random(seed)
    return {m: {f"i{x}" for x in range(items) if rng.random() < chance} for m in range(members)}


@pytest.mark.parametrize("chance", [0.1, 0.6, 1.0])
def test_members_that_share_an_item_are_counted_by_sets(spark, chance):
    graphs = {g: drawn(g, 40, 8, chance) for g in (0, 1)}
    df = spark.createDataFrame([(g, m, i) for g, s in graphs.items() for m, own in s.items() for i in own], "replicate long, left long, right string")
    want = {}
    for g, s in graphs.items():
        common = [len(s[a] & s[b]) for a, b in itertools.combinations(s, 2)]
        want[g] = (sum(c > 0 for c in common), sum(common))
    assert {r.replicate: (r.n_pairs, r.n_shared) for r in sets.meeting_members(df, "replicate", "left", "right").collect()} == want


def test_pairs_are_counted_by_item(spark):
    own = drawn(5, 30, 6, 0.4)
    pairs = [p for p in itertools.combinations(own, 2) if sum(p) % 3]
    want = collections.Counter(i for a, b in pairs for i in own[a] & own[b])
    held = spark.createDataFrame([(m, i) for m, s in own.items() for i in s], "firm long, office string")
    got = sets.pairs_by_item(spark.createDataFrame(pairs, "a long, b long"), held, "firm", "office").collect()
    assert {r.office: r.n for r in got} == want


def test_cycles_of_up_to_six_steps_are_found_once(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(30)}
    want = {(n, ">".join(map(str, p))) for n in range(2, 7) for p in itertools.permutations(range(9), n) if p[0] == min(p) and all((p[k], p[(k + 1) % n]) in edges for k in range(n))}
    got = [tuple(r) for r in graph.cycles(spark.createDataFrame(sorted(edges), "src long, dst long"), 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_footprints_match_all_pairs(spark):
    own = {m: s for m, s in drawn(6, 60, 9, 0.6).items() if s}
    rows = [(1000 * m + k, m, i, 10.0 * m) for m, s in own.items() for k, i in enumerate(sorted(s))] + [(-1, 1, "i0", 5.0), (-1, 2, "i0", 5.0)]
    own[1], own[2] = own[1] | {"i0"}, own[2] | {"i0"}
    value = collections.Counter()
    for _, m, _, v in rows:
        value[m] += v
    want = {}
    for a, b in itertools.combinations(sorted(own), 2):
        n = len(own[a] & own[b])
        if n >= 3 and n / len(own[a] | own[b]) >= 0.6 and (a, b) != (1, 2) and value[a] >= 100 and value[b] >= 100:
            want[a, b] = (n, round(n / len(own[a] | own[b]), 6), value[a] + value[b])
    df = spark.createDataFrame(rows, "ref long, firm long, office string, amount double")
    got = {(r.a, r.b): (r.shared, r.jaccard, r.val) for r in temporal.footprints(df, 1, 100, 3, 0.6).collect()}
    assert got == want
