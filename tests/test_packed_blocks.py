"""Blocks of members that are packed once: against plain Python, and without a row for an item and two blocks or for a pair."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from awardlens.operators import blocks, embed, graph, temporal
from awardlens.plans import structure, views


@pytest.fixture(scope="module")
def sparse():
    rng = random.Random(3)
    return {p for p in itertools.combinations(range(300), 2) if rng.random() < 0.06}


def around(edges):
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def test_a_block_goes_to_tasks_in_one_row_however_many_items_its_members_have(spark, sparse, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 64)
    edges = spark.createDataFrame(sorted(sparse), "src long, dst long")
    held = edges.selectExpr("0 AS grp", "src AS item", "dst AS member", "1.0D AS x", "1.0D AS u")
    rows = blocks._rows(held, None)[0]
    assert rows.count() <= 5 * 6 < held.select("item").distinct().count()
    near = around(sparse)
    got = [tuple(r) for r in graph.triangles(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b, c) for a, b in sparse for c in near[a] & near[b] if c > b}


def test_partners_in_common_of_open_pairs(spark, sparse, monkeypatch):
    for name, value in (("SIZE", 64), ("CELLS", 640), ("PLACES", 50)):
        monkeypatch.setattr(blocks, name, value)
    near, edges = around(sparse), spark.createDataFrame(sorted(sparse), "src long, dst long")
    want = {(a, b): near[a] & near[b] for a, b in itertools.combinations(range(300), 2) if (a, b) not in sparse and near[a] & near[b]}
    got = {(r.a, r.b): (r.score, r.common) for r in graph.open_adamic_adar(edges, 6).collect()}
    assert got.keys() == want.keys() and all(n == len(want[p]) and abs(s - sum(1 / math.log(len(near[m])) for m in want[p] if len(near[m]) > 1)) < 1e-6 for p, (s, n) in got.items())
    best = sorted(want, key=lambda p: (-len(want[p]), p))[:15]
    assert [tuple(r) for r in graph.most_common_partners(edges, 15).collect()] == [(*p, len(want[p])) for p in best]


def test_the_best_footprints_are_the_first_of_all(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 64)
    rng = random.Random(4)
    rows = [(k, k % 150, rng.choice("abcdefg"), float(rng.randrange(1, 9))) for k in range(1500)]
    awards = spark.createDataFrame(rows, "ref long, firm long, office string, amount double")
    every = temporal.footprints(awards, 1, 10, 3, 0.6).collect()
    want = sorted(every, key=lambda r: (-r.val, r.a, r.b))[:12]
    got = temporal.best_footprints(awards, 1, 10, 3, 0.6, 12).collect()
    assert [tuple(r) for r in got] == [(*r, len(every)) for r in want] and len(every) > 500


def test_steps_over_shared_offices_are_found_without_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 64)
    rng = random.Random(5)
    at = {m: set(rng.sample(range(24), 4)) for m in range(200)}
    linked = {p for p in itertools.combinations(at, 2) if rng.random() < 0.1}
    owners = [(f"P{m}", f"F{m + 100}") for m in range(0, 150, 7)]
    near = around([(f"F{a}", f"F{b}") for a, b in itertools.combinations(at, 2) if len(at[a] & at[b]) >= 2 and (a, b) not in linked] + owners)
    held = spark.createDataFrame([(0, o, m, 1.0, 1.0) for m, s in at.items() for o in s], "grp int, item long, member long, x double, u double")
    links = spark.createDataFrame([(0, a, b, 0) for a, b in linked], "grp int, a long, b long, since int")
    for some in (owners, [("A0", "F199")]):
        graph_ = collections.defaultdict(set, {k: set(v) for k, v in near.items()})
        for a, b in some:
            graph_[a].add(b)
            graph_[b].add(a)
        start = min(graph_)
        want, front = {start: 0}, {start}
        for d in (1, 2, 3):
            front = {y for x in front for y in graph_[x]} - want.keys()
            want |= dict.fromkeys(front, d)
        used = owners if some is owners else owners + some
        df = spark.createDataFrame(used, "source string, target string")
        assert {r.id: r.dist for r in views._steps_over_places(df, held, links, 3, 2).collect()} == want


def test_numbers_above_are_told_by_steps():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 50), (400, 3000)):
        marks, values = np.round(rng.random(n), 2), np.round(rng.random(m) * 1.4 - 0.2, 2)
        assert blocks._Marks(marks).twice(values) == sum(2 * int((v < marks).sum()) + int((v == marks).sum()) for v in values)


def test_predicted_ties_are_the_best_open_pairs_by_cosine(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 64)
    rng = random.Random(6)
    at, vector = {m: set(rng.sample(range(9), 2)) for m in range(150)}, {m: [rng.gauss(0, 1) for _ in range(5)] for m in range(150)}
    linked = {p for p in itertools.combinations(at, 2) if rng.random() < 0.2}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    open_ = {(a, b): round(cosine(vector[a], vector[b]), 6) for a, b in itertools.combinations(at, 2) if at[a] & at[b] and (a, b) not in linked}
    best = sorted((p for p in open_ if open_[p] >= 0.5), key=lambda p: (-open_[p], p))[:30]
    held = spark.createDataFrame([(0, o, m, 1.0, 1.0) for m, s in at.items() for o in s], "grp int, item long, member long, x double, u double")
    vectors = spark.createDataFrame(list(vector.items()), "id long, vector array<double>")
    links = spark.createDataFrame([(0, a, b, 0) for a, b in linked], "grp int, a long, b long, since int")
    assert [tuple(r) for r in embed.predicted_ties(vectors, held, links, 0.5, 30).collect()] == [(*p, open_[p], len(at[p[0]] & at[p[1]])) for p in best]


def test_open_pairs_on_rewired_graphs_score_as_given_ones(spark, monkeypatch):
    for name, value in (("BROAD", 64), ("CELLS", 640), ("CHUNK", 2)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(7)
    rows = [(f * 100 + k, f, rng.choice("abcdefghij"), rng.randrange(1993, 1999)) for f in range(130) for k in range(5)]
    rows += [(90_000 + k, f, rng.choice("abc"), rng.randrange(1994, 1999)) for k in range(300) for f in rng.sample(range(130), 2)]
    awards = spark.createDataFrame(rows, "ref long, firm long, office string, year int").cache()
    big = awards.select("firm").where("firm % 9 <> 0").distinct()
    drawn = []

    def lists(graphs, rounds):
        drawn.append(embed.swapped_lists(graphs, rounds).cache())
        return drawn[0]

    monkeypatch.setattr(temporal, "swapped_lists", lists)
    cuts, times = [1996, 1997], 3
    got = {(r.cut, r.replicate): r.auc for r in temporal.rewired_open_nulls(awards, big, cuts, times).collect()}
    known = temporal.known_by(awards.join(big, "firm", "left_semi"), cuts).cache()
    names = sorted(r.office for r in known.select("office").distinct().collect())
    graphs = [((r.replicate - 1) // times, (r.replicate - 1) % times + 1, r.left, names[o]) for r in drawn[0].collect() for o in r.rights]
    candidates = temporal.link_candidates(awards, big, cuts)
    want = temporal.rewired_auc(candidates, known, spark.createDataFrame(graphs, "cut int, replicate long, firm long, office string"), times)
    assert got == {(r.cut, r.replicate): r.auc for r in want.collect()} and len(got) == 6
    assert len(set(graphs)) == len(graphs) and {(c, f, o) for c, _, f, o in graphs} != {(r.cut, r.firm, r.office) for r in known.collect()}


def test_firms_of_the_same_offices_by_a_year_are_one_node_of_it(spark):
    rng = random.Random(8)
    rows = [(f, f"O{o}", 2000 + rng.randrange(3)) for f in range(60) for o in rng.sample(range(6), 5)]
    first, years = spark.createDataFrame(rows, "firm long, office string, since int"), spark.createDataFrame([(y,) for y in (2000, 2001, 2002)], "graph int")
    edges, members = structure.sharing_years(first, years)
    held = {y: {f: frozenset(o for g, o, s in rows if g == f and s <= y) for f in range(60)} for y in (2000, 2001, 2002)}
    node = {(r.graph, r.firm): r.id for r in members.collect()}
    assert node == {(y, f): min(g for g, t in of.items() if t == s) for y, of in held.items() for f, s in of.items() if s}
    assert len({i for (y, _), i in node.items() if y == 2002}) <= 6  # of 60 firms with 60 ways there
    want = collections.Counter()
    for y, of in held.items():
        for a, b in itertools.combinations(range(60), 2):
            if len(of[a] & of[b]) >= 2:
                want[y, *sorted((node[y, a], node[y, b]))] += len(of[a] & of[b])
    assert {(r.graph, r.src, r.dst): r.weight for r in edges.collect()} == want
