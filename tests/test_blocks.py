"""Pairs in blocks, and what is made of them, against plain Python."""

import collections
import itertools
import math
import random

import pytest

from awardlens.operators import blocks, graph, temporal


def shared(seed, n, items, chance, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 64)
    rng = random.Random(seed)
    held = {(g, i, m): rng.choice([0.5, 1.0, 0.25]) for g in (1, 2) for i in range(items) for m in range(10, 10 + n) if rng.random() < chance}
    u = {(g, i): rng.random() for g in (1, 2) for i in range(items)}
    links = {p: rng.randrange(4) for p in itertools.combinations(range(10, 10 + n), 2) if rng.random() < 0.3}
    want = {}
    for g in (1, 2):
        for (a, b) in itertools.combinations(range(10, 10 + n), 2):
            both = [i for i in range(items) if (g, i, a) in held and (g, i, b) in held]
            if both and links.get((a, b), 9) > g:
                want[g, a, b] = (sum(u[g, i] * held[g, i, a] * held[g, i, b] for i in both), len(both), links.get((a, b)) == g + 1)
    return held, u, links, want


@pytest.mark.parametrize(("n", "items", "chance"), [(20, 6, 0.3), (150, 9, 0.05), (150, 70, 0.9)])
def test_open_pairs_and_their_auc_match_all_pairs(spark, monkeypatch, n, items, chance):
    held, u, links, want = shared(n, n, items, chance, monkeypatch)
    rows = spark.createDataFrame([(g, i, m, x, u[g, i]) for (g, i, m), x in held.items()], "grp int, item long, member long, x double, u double")
    known = spark.createDataFrame([(g, b, a, s) for g in (1, 2) for (a, b), s in links.items()], "grp int, a long, b long, since int")
    got = blocks.open_pairs(rows, known).collect()
    assert len(got) == len(want) and all(math.isclose(want[r.grp, r.a, r.b][0], r.score, abs_tol=1e-9) and want[r.grp, r.a, r.b][1:] == (r.common, r.next) for r in got)
    assert {(r.grp, r.a, r.b) for r in blocks.open_pairs(rows, known, True).collect()} == {k for k, v in want.items() if v[2]}
    found = {r.grp: r for r in blocks.open_auc(rows, known).collect()}
    for g in (1, 2):
        yes, no = ([round(v[0], 9) for k, v in want.items() if k[0] == g and v[2] is p] for p in (True, False))
        auc = sum((x > y) + (x == y) / 2 for x in yes for y in no) / (len(yes) * len(no))
        assert (found[g].n, found[g].n_pos) == (len(yes) + len(no), len(yes)) and math.isclose(found[g].auc, auc, abs_tol=1e-6)


def test_random_orders_draw_every_set_of_places_alike(spark):
    rows = spark.createDataFrame([(1, i, i + 1, float(i), i < 2) for i in range(4)], "cut int, a long, b long, score double, positive boolean")
    drawn = collections.Counter(r.auc for r in temporal.permutation_nulls(rows, 1200).collect())
    # six sets of two places of four: one each gives 0, 1/4, 3/4 and 1, two give 1/2
    assert {k: round(v / 200) for k, v in drawn.items()} == {0.0: 1, 0.25: 1, 0.5: 2, 0.75: 1, 1.0: 1}


def test_random_orders_rank_no_rows(spark, monkeypatch):
    monkeypatch.setattr(temporal, "auc", None)
    rows = spark.range(40_000).selectExpr("1 AS cut", "id AS a", "id + 1 AS b", "id * 1.0 AS score", "id % 9 < 8 AS positive")
    got = temporal.permutation_nulls(rows, 50).agg({"auc": "avg", "n": "max"}).first()
    assert got["max(n)"] == 40_000 and abs(got["avg(auc)"] - 0.5) < 0.01
