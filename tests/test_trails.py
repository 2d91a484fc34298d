"""First trails and cycles of all lengths against all of them."""

import random

import pytest

from awardlens.operators import trails


def plain_cycles(edges, longest, limit, start=None):
    found, now = [], [([a, b], [(a, b)], [w]) for a, b, w in edges if a != b and (start is None or a == start)]
    for n in range(2, longest + 1):
        now = [(ns + [b], used + [(a, b)], ws + [w]) for ns, used, ws in now for a, b, w in edges if a == ns[-1] and a != b and (a, b) not in used]
        found += sorted((n, ">".join(map(str, ns)), ",".join(f"{w:.2f}" for w in ws)) for ns, _, ws in now if ns[0] == ns[-1])
    return found[:limit]


def plain_trails(edges, start, shortest, longest, least, limit):
    ways = [(i, a, b, t) for i, a, b, t in edges] + [(i, b, a, t) for i, a, b, t in edges]
    found, now = [], [([start], [], set())]
    for n in range(1, longest + 1):
        now = [(ns + [b], used + [i], ts | {t}) for ns, used, ts in now for i, a, b, t in ways if a == ns[-1] and i not in used]
        if n >= shortest:
            found += [(-len(ts), n, ">".join(map(str, ns))) for ns, _, ts in now if ns[-1] != start and len(ts) >= least]
    return [(n, p, -t) for t, n, p in sorted(found)[:limit]]


@pytest.mark.parametrize("seed", range(5))
def test_cycles_of_two_to_six_steps(spark, seed, monkeypatch):
    monkeypatch.setattr(trails, "KEPT", 3)
    rng = random.Random(seed)
    n, m, limit = ((5, 8, 30), (9, 12, 8), (12, 14, 6), (4, 12, 15), (15, 14, 4))[seed]
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    rows = [(a, b, float(i)) for i, (a, b) in enumerate(edges)]
    df = spark.createDataFrame(rows, "src long, dst long, amount double")
    for start in (None, rows[0][0]):
        got = sorted(map(tuple, trails.first_cycles(df, 6, limit, start).collect()), key=lambda r: r[:2])
        assert got == plain_cycles(rows, 6, limit, start)


@pytest.mark.parametrize("seed", range(5))
def test_trails_of_most_types(spark, seed, monkeypatch):
    monkeypatch.setattr(trails, "KEPT", 3)
    rng = random.Random(10 + seed)
    n, m, limit = ((5, 7, 20), (9, 12, 6), (12, 12, 9), (4, 6, 40), (20, 15, 3))[seed]
    edges = [(i, rng.randrange(n), rng.randrange(n), rng.choice("xyz")) for i in range(m)]
    edges = [e for e in edges if e[1] != e[2]]
    df = spark.createDataFrame(edges, "id long, src long, dst long, type string")
    start = edges[0][1]
    got = sorted((-r.n_types, r.hops, r.path) for r in trails.diverse_trails(df, start, 2, 6, 2, limit).collect())
    assert [(h, p, -t) for t, h, p in got] == plain_trails(edges, start, 2, 6, 2, limit)
