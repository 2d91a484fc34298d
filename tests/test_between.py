"""Betweenness in blocks of nodes and parts of pivots against sums over single pivots."""

import collections
import math
import random

from awardlens.operators import between, graph


def plain(edges, pivots):
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total = dict.fromkeys(near, 0.0)
    for s in sorted(near)[:pivots]:
        level, paths, order = {s: 0}, collections.Counter({s: 1}), [s]
        for v in order:
            for w in near[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        back = collections.Counter()
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    back[v] += paths[v] / paths[w] * (1 + back[w])
            if w != s:
                total[w] += back[w]
    n = len(near)
    return {v: x * n / min(n, pivots) / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_blocks_and_parts_give_what_single_pivots_give(spark, monkeypatch):
    monkeypatch.setattr(between, "LONG", 16)
    rnd = random.Random(5)
    edges = {(0, x) for x in range(1, 120)} | {(rnd.randrange(300), rnd.randrange(300)) for _ in range(500)} | {(300 + i, 301 + i) for i in range(12)}
    edges = [(a, b) for a, b in edges if a != b]
    want = plain(edges, 200)
    both = graph.undirected(spark.createDataFrame(edges, "src long, dst long"))
    assert len(want) > 4 * 64 and between.WIDTH < 200
    got = {r.id: r.betweenness for r in between.betweenness(both, 200).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[v], want[v], abs_tol=2e-9) for v in want)


def test_no_edges_give_no_rows(spark):
    assert graph.betweenness(spark.createDataFrame([], "src long, dst long")).count() == 0
