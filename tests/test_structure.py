"""Communities, forests, chains and ranks against plain Python."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from awardlens.operators import chains, communities, graph, growth
from awardlens.plans import structure


def plain_modularity(edges, label):
    m = sum(w for _, _, w in edges)
    inside, k = collections.Counter(), collections.Counter()
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += w
    return sum(inside[c] / m - (k[c] / (2 * m)) ** 2 for c in k)


def plain_louvain(edges):
    """Sequential local moves and contraction."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    member = {n: n for n in nodes}
    now = edges
    while True:
        around = collections.defaultdict(collections.Counter)
        k, m2 = collections.Counter(), 2 * sum(w for _, _, w in now)
        for a, b, w in now:
            k[a] += w
            k[b] += w
            if a != b:
                around[a][b] += w
                around[b][a] += w
        c = {n: n for n in k}
        tot = collections.Counter(k)
        moved = changed = True
        while moved:
            moved = False
            for n in sorted(k):
                links = collections.Counter()
                for x, w in around[n].items():
                    links[c[x]] += w
                tot[c[n]] -= k[n]
                best = max([*links, c[n]], key=lambda q: (links[q] - k[n] * tot[q] / m2, q == c[n]))
                moved |= best != c[n]
                c[n] = best
                tot[best] += k[n]
        changed = len(set(c.values())) < len(k)
        member = {n: c[x] for n, x in member.items()}
        if not changed:
            return member
        now = [(c[a], c[b], w) for a, b, w in now]


def blocks(seed, groups, size, inner, outer):
    rng = random.Random(seed)
    nodes = [(g, i) for g in range(groups) for i in range(size)]
    return [(f"n{a[0]}_{a[1]}", f"n{b[0]}_{b[1]}", float(rng.choice([1, 1, 2]))) for a, b in itertools.combinations(nodes, 2) if rng.random() < (inner if a[0] == b[0] else outer)]


def ring(n, size):
    edges = [(f"c{g}_{i}", f"c{g}_{j}", 1.0) for g in range(n) for i in range(size) for j in range(i)]
    return edges + [(f"c{g}_0", f"c{(g + 1) % n}_1", 1.0) for g in range(n)]


def star(n):
    return [("hub", f"s{i}", 1.0) for i in range(n)]


def test_louvain_is_near_the_sequential_one_on_many_graphs_at_once(spark):
    graphs = [blocks(1, 5, 12, 0.6, 0.03), blocks(2, 8, 8, 0.8, 0.05), ring(12, 4), star(40), [("a", "b", 2.0), ("c", "c", 1.0), ("c", "d", 1.0)], blocks(4, 6, 20, 0.2, 0.02), blocks(3, 1, 25, 0.3, 0)]
    rows = [(g, *e) for g, edges in enumerate(graphs) for e in edges]
    e = spark.createDataFrame(rows, "graph int, src string, dst string, weight double").withColumn("EXTRA", F.lit(1))
    labels = communities.louvain(e)
    found = collections.defaultdict(dict)
    for r in labels.collect():
        found[r.graph][r.id] = r.community
    reported = {r.graph: r for r in communities.modularity(e, labels).collect()}
    for g, edges in enumerate(graphs):
        own = plain_modularity(edges, found[g])
        assert abs(own - reported[g].modularity) < 1e-9 and reported[g].communities == len(set(found[g].values()))
        # the last graph is random, without communities: there any order of moves ends elsewhere
        assert own >= plain_modularity(edges, plain_louvain(edges)) * (0.9 if g == 6 else 0.98) - 1e-9, g
        members = collections.defaultdict(list)
        for n, c in found[g].items():
            members[c].append(n)
        assert all(min(ns) == c for c, ns in members.items())
    assert len(set(found[2].values())) < 13  # cliques of a ring stay whole
    alone = {r.id: r.community for r in communities.louvain(e.where("graph = 1")).collect()}
    assert alone == found[1]
    assert communities.louvain(e.limit(0)).count() == 0


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}", rng.randrange(2000, 2006)) for _ in range(m)]


def plain_components(edges):
    root = {x: x for a, b, _ in edges for x in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        root[find(a)] = find(b)
    return collections.Counter(find(x) for x in root)


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 40, 60), (2, 60, 40), (3, 12, 80)])
def test_forest_and_replay_match_all_edges_of_every_year(spark, seed, n, m):
    edges = random_graph(seed, n, m)
    df = spark.createDataFrame(edges, "src string, dst string, year int")
    forest = [tuple(r) for r in growth.spanning_forest(df).select("src", "dst", "year").collect()]
    loopless = [e for e in edges if e[0] != e[1]]
    for y in range(2000, 2006):
        upto = lambda es, y=y: [e for e in es if e[2] <= y]
        assert sorted(plain_components(upto(forest)).values()) == sorted(plain_components(upto(loopless)).values())
    assert len(forest) == len({x for e in loopless for x in e[:2]}) - len(plain_components(loopless))
    first = {}
    for a, b, y in edges:
        for x in (a, b):
            first[x] = min(y, first.get(x, y))
    assert {r.id: r.reveal for r in growth.reveal_years(df).collect()} == first
    got = {r.year: (r.nodes, r.edges, r.giant) for r in growth.replay(df).collect()}
    years = range(min(e[2] for e in edges), max(e[2] for e in edges) + 1)
    assert got == {y: (sum(v <= y for v in first.values()), sum(e[2] <= y for e in edges), max(plain_components([e for e in edges if e[2] <= y]).values())) for y in years}


def test_years_without_new_edges_keep_what_is_there(spark):
    edges = spark.createDataFrame([("a", "b", 2001), ("b", "c", 2003)], "src string, dst string, year int")
    years = spark.createDataFrame([(2000,), (2005,)], "year int")
    got = {r.year: (r.nodes, r.edges, r.giant) for r in growth.replay(edges, years).collect()}
    assert got == {2000: (0, 0, 0), 2001: (2, 1, 2), 2002: (2, 1, 2), 2003: (3, 2, 3), 2004: (3, 2, 3), 2005: (3, 2, 3)}


def test_replay_of_no_edges(spark):
    assert growth.replay(spark.createDataFrame([], "src string, dst string, year int")).count() == 0


def plain_chains(edges, starts, longest, limit):
    ways = [(i, a, b, t) for i, a, b, t in edges if a != b] + [(i, b, a, t) for i, a, b, t in edges if a != b]
    now, found = [([(s, "")], []) for s in starts], []
    for hops in range(1, longest + 1):
        now = [(steps + [(b, i)], types + [t]) for steps, types in now for i, a, b, t in ways if a == steps[-1][0] and i not in {s[1] for s in steps}]
        found += [(-hops, steps, types) for steps, types in now if steps[-1][0] != steps[0][0]]
    return [(steps[0][0], -h, ">".join(s[0] for s in steps), ">".join(types)) for h, steps, types in sorted(found)[:limit]]


@pytest.mark.parametrize("seed", range(4))
def test_chains_match_all_trails(spark, seed, monkeypatch):
    rng = random.Random(seed)
    n, m = ((7, 9), (12, 10), (6, 12), (9, 6))[seed]
    edges = [(f"e{i}", f"v{rng.randrange(n)}", f"v{rng.randrange(n)}", rng.choice("xyz")) for i in range(m)]
    starts = sorted({f"v{rng.randrange(n)}" for _ in range(4)})
    e = spark.createDataFrame(edges, "id string, src string, dst string, type string")
    s = spark.createDataFrame([(x,) for x in starts], "id string")
    monkeypatch.setattr(chains, "CARRIED", 2)
    got = [tuple(r) for r in chains.longest_chains(e, s, 5, 6).collect()]
    want = plain_chains(edges, starts, 5, 6)
    assert sorted(got, key=lambda r: (-r[1], r[2])) == sorted(want, key=lambda r: (-r[1], r[2]))


def test_steps_ahead_are_those_of_walks_that_do_not_turn_back(spark):
    edges = [("a", "1", "2"), ("b", "2", "3"), ("c", "3", "4"), ("d", "2", "5"), ("e", "6", "7")]
    e = spark.createDataFrame([(i, a, b, "t") for i, a, b in edges], "id string, src string, dst string, type string")
    got = {(r.src, r.dst): r.ahead for r in chains.reach_ahead(e, 4).collect()}
    assert got == {("1", "2"): 2, ("2", "1"): 0, ("2", "3"): 1, ("3", "2"): 1, ("3", "4"): 0, ("4", "3"): 2, ("2", "5"): 0, ("5", "2"): 2, ("6", "7"): 0, ("7", "6"): 0}


def plain_ranks(edges, rounds=300, d=0.85):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    out = collections.Counter()
    for a, _, w in edges:
        out[a] += w
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        idle = sum(r for n, r in rank.items() if not out[n])
        fresh = dict.fromkeys(nodes, (1 - d) / len(nodes) + d * idle / len(nodes))
        for a, b, w in edges:
            fresh[b] += d * rank[a] * w / out[a]
        rank = fresh
    return rank


def test_converged_ranks_match_power_iteration_and_resume(spark, tmp_path):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0), ("e", "d", 1.0), ("a", "b", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    want = plain_ranks(edges)
    for tolerance, near in ((1e-6, 1e-5), (1e-12, 1e-9)):
        got = {r.id: r.rank for r in graph.pagerank_converged(e, tolerance=tolerance).collect()}
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < near for n in want)
    folder = f"file://{tmp_path}/ranks"
    with pytest.raises(RuntimeError):
        graph.pagerank_converged(e, tolerance=1e-12, most=8, resume=folder)
    got = {r.id: r.rank for r in graph.pagerank_converged(e, tolerance=1e-12, resume=folder).collect()}
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)
    assert graph.pagerank_converged(e.limit(0)).count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    with pytest.raises(RuntimeError):
        graph.components(e, rounds=2)


def test_firms_of_the_same_offices_are_one_node_of_the_same_modularity(spark):
    """Copies of firms add nodes to the graph of pairs, none to that of classes, and a division has the same modularity in both."""
    rng = random.Random(5)
    kinds = {k: {o: rng.randrange(3) for o in rng.sample(range(12), 5)} for k in range(9)}
    rows = [(10 * copy + k, f"O{o}", 2000 + y) for copy in range(7) for k, offices in kinds.items() for o, y in offices.items()]
    first, years = spark.createDataFrame(rows, "firm long, office string, since int"), spark.createDataFrame([(2000,), (2001,), (2002,)], "graph int")
    edges, members = structure.sharing_classes(first, years)
    assert {(r.id, r.firm) for r in members.collect()} == {(f % 10, f) for f, _, _ in rows}
    assert edges.select("src").union(edges.select("dst")).distinct().count() <= len(kinds)
    labels = communities.louvain(edges)
    spread = labels.join(members, "id").select("graph", F.col("firm").alias("id"), "community")
    pairs = structure.sharing_pairs(first, years, 2)
    small, large = ({r.graph: (r.communities, round(r.modularity, 9)) for r in communities.modularity(*x).collect()} for x in ((edges, labels), (pairs, spread)))
    assert small == large and len(small) == 3
    direct = {r.graph: r.modularity for r in communities.modularity(pairs, communities.louvain(pairs)).collect()}
    assert all(large[g][1] >= 0.98 * q - 1e-9 for g, q in direct.items()), (large, direct)
