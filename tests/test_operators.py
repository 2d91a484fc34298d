"""Operators on small frames, against plain Python."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.operators import flags, graph, quality, resolve, rollups, temporal, walks
from awardlens.sources import files
from awardlens.streaming import monitor

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        ("ALPHA BUILDERS INC. (1001)", [("1001", False, None, "ALPHA BUILDERS INC", "ALPHA BUILDERS INC")]),
        ("BETA CORP ([REVOKED] 1002)", [("1002", True, None, "BETA CORP", "BETA CORP")]),
        ("GAMMA CO (FORMERLY: OLD GAMMA) (1003)", [("1003", False, "OLD GAMMA", "GAMMA CO", "GAMMA CO")]),
        ("DELTA (FORMERLY: OLD DELTA (1004)", [("1004", False, "OLD DELTA (1004", "DELTA", "DELTA")]),
        ("EPSILON WORKS", [(None, False, None, "EPSILON WORKS", "EPSILON WORKS")]),
        ("A/B (3)", [("3", False, None, "A/B", "A B")]),
        (None, []),
        ("", []),
        ("   ", []),
        (" / ", []),
    ],
)
def test_contractor_cells(spark, cell, want):
    got = one(spark, cell, fn.contractor_cell) or []
    assert [(x.id, x.revoked, x.former, x.display, x.norm) for x in got] == want


def test_resolution_takes_ids_seen_with_a_name(spark):
    cells = [(1, "ALPHA INC. (7)"), (2, "ALPHA INC. / BETA"), (3, "ALPHA INC. (7) / GAMMA (8) / ALPHA INC. (7)"), (4, None)]
    got = resolve.resolved(resolve.parsed(spark.createDataFrame(cells, "ref long, contractor string"))).collect()
    assert sorted((r.ref, r.key) for r in got) == [(1, "7"), (2, "7"), (2, "n:BETA"), (3, "7"), (3, "8")]


@pytest.mark.parametrize(("raw", "want"), [("₱1,234.50", 1234.5), ("100-200", 100.0), ("-5", None), ("n/a", None), (None, None), ("$ 7", 7.0)])
def test_money(spark, raw, want):
    assert one(spark, raw, fn.money) == want


@pytest.mark.parametrize(("raw", "want"), [("2020-02-03", "2020-02-03"), ("02/03/2020", "2020-02-03"), ("03-Feb-20", "2020-02-03"), ("3-Feb-2020", "2020-02-03"), ("February 3, 2020", "2020-02-03"), ("3 February 2020", "2020-02-03"), ("03-Feb-85", "1985-02-03"), ("2020/02/03", None), ("soon", None), (None, None)])
def test_dates(spark, raw, want):
    got = one(spark, raw, fn.parsed_date)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [
        (fn.surname, "Dela Cruz, Juan", "DELA CRUZ"),
        (fn.surname, "Juan Reyes Jr.", "REYES"),
        (fn.company_name, "Alpha Construction & Builders, Inc.", "ALPHA CONSTRUCTION & BUILDERS"),
        (fn.company_name, "Beta & Co.", "BETA &"),
        (fn.company_name, "Inc Gamma LLC", "INC GAMMA"),
        (fn.person_name, "Juan de la Cruz III", "JUAN DELA CRUZ"),
        (fn.search_form, "  Niño-Pérez  Co. ", "nino perez co"),
        (fn.locality, "Unit 1, Main St., Cebu City, Region VII", "MAIN ST / CEBU CITY / REGION VII"),
        (fn.lucene_prefix, "a+b", r"a\+b*"),
        (fn.status_group, "Completed", "completed"),
        (fn.method_class, "Negotiated Procurement", "negotiated"),
        (fn.method_class, "follow-on highway", "other"),
        (fn.method_class, "Direct Contracting", "negotiated"),
        (fn.status_group, "F", "f"),
    ],
)
def test_text_functions(spark, f, raw, want):
    assert one(spark, raw, f) == want


def test_peso_units(spark):
    assert [one(spark, v, fn.pesos, "double") for v in (1.5e12, 2e9, 3.25e6, 4e3, 5.0)] == ["1.50T", "2.00B", "3.25M", "4.00K", "5.00"]


def test_jaro_winkler_known_values():
    assert round(resolve._jaro_winkler("MARTHA", "MARHTA"), 5) == 0.96111
    assert round(resolve._jaro_winkler("DWAYNE", "DUANE"), 2) == 0.84
    assert resolve._jaro_winkler("", "A") == 0 and resolve._jaro_winkler("A", "A") == 1


@SLOW
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(1, 5), st.integers(0, 1000)), min_size=1, max_size=25))
def test_concentration_bounds(spark, rows):
    got = rollups.hhi(spark.createDataFrame(rows, "office string, firm int, amount int"), ["office"]).collect()
    for r in got:
        sums = {}
        for o, f, v in rows:
            if o == r.office:
                sums[f] = sums.get(f, 0) + v
        total = sum(sums.values())
        want = sum((100 * v / total) ** 2 for v in sums.values()) if total else 0
        assert math.isclose(r.hhi, want, abs_tol=1e-3) and r.n_firms == len(sums)
        assert not total or 10000 / len(sums) - 1e-3 <= r.hhi <= 10000


def small_graph():
    rnd = random.Random(9)
    return sorted({tuple(sorted(rnd.sample(range(24), 2))) for _ in range(40)})


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def test_components_of_chains_and_trees(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (7, 7), (5, 3), (3, 9)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 3, 5: 3, 9: 3}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_betweenness_matches_all_shortest_paths(spark):
    edges = small_graph()
    near = neighbours(edges)

    def paths(s, t):
        found, front = [], [[s]]
        while front and not found:
            found = [p for p in front if p[-1] == t]
            front = [[*p, w] for p in front for w in near[p[-1]] if w not in p]
        return found

    want = dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        every = paths(s, t)
        for p in every:
            for v in p[1:-1]:
                want[v] += 1 / len(every)
    n = len(near)
    got = {r.id: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[v], want[v] / ((n - 1) * (n - 2)), abs_tol=1e-6) for v in want)


def test_pagerank_matches_power_iteration(spark):
    edges = [(a, b, 1.0 + a % 3) for a, b in small_graph()]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[nodes.index(b), nodes.index(a)] += w
        m[nodes.index(a), nodes.index(b)] += w
    m /= m.sum(0)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(12):
        rank = 0.15 / len(nodes) + 0.85 * m @ rank
    got = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long, weight double"), 12).collect()}
    assert np.allclose([got[v] for v in nodes], rank)


def test_paths_and_cycles_match_search(spark):
    rnd = random.Random(4)
    edges = sorted({tuple(rnd.sample(range(9), 2)) for _ in range(22)})
    e = spark.createDataFrame(edges, "src long, dst long")
    want = set()
    for n in (2, 3, 4):
        for p in itertools.permutations(range(9), n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in edges for i in range(n)):
                want.add((n, ">".join(map(str, p))))
    assert {(r.hops, r.cycle) for r in graph.cycles(e, 4).collect()} == want
    near = neighbours(edges)
    dist, front = {0: 0}, [0]
    while front:
        front = [dist.setdefault(w, dist[v] + 1) and w for v in front for w in near.get(v, ()) if w not in dist]
    got = {r.id: r.dist for r in graph.distances(e, 0, 3).collect()}
    assert got == {v: d for v, d in dist.items() if d <= 3}
    far = max(dist, key=dist.get)
    path = graph.shortest_path(e, 0, far).first()
    assert path.hops == dist[far]
    assert graph.shortest_path(e, 0, 999).count() == 0


def test_label_propagation_separates_cliques(spark):
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(5), 2)] + [(a, b, 1.0) for a, b in itertools.combinations(range(10, 15), 2)] + [(4, 10, 0.1)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = graph.label_propagation(e, 6)
    got = {r.id: r.label for r in labels.collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[12]
    assert graph.modularity(e, labels).first().modularity > 0.4


def test_pettitt_matches_the_definition(spark):
    series = {"up": [1, 2, 1, 2, 9, 8, 9, 10, 9], "flat": [3, 3, 3, 3], "down": [9.5, 9, 8, 2, 1, 1.5]}
    rows = [(m, 2000 + i, float(x)) for m, xs in series.items() for i, x in enumerate(xs)]
    got = {r.metric: r for r in temporal.pettitt(spark.createDataFrame(rows, "metric string, year int, x double")).collect()}
    for m, xs in series.items():
        n = len(xs)
        u = [sum(np.sign(xs[i] - xs[j]) for i in range(t) for j in range(t, n)) for t in range(1, n)]
        t = int(np.argmax(np.abs(u)))
        p = min(1, 2 * math.exp(-6 * abs(u[t]) ** 2 / (n**3 + n**2)))
        assert got[m].change_after == 2000 + t and math.isclose(got[m].p_value, p, abs_tol=1e-4)
        assert math.isclose(got[m].before_mean, np.mean(xs[: t + 1]), abs_tol=1e-3)


def test_auc_with_ties(spark):
    rnd = random.Random(2)
    rows = [(1, rnd.choice((0.1, 0.2, 0.3, 0.4)), rnd.random() < 0.3) for _ in range(60)]
    pos, neg = [s for _, s, p in rows if p], [s for _, s, p in rows if not p]
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    got = temporal.auc(spark.createDataFrame(rows, "cut int, score double, positive boolean"), ["cut"]).first()
    assert math.isclose(got.auc, want, abs_tol=1e-6)


def test_permutation_nulls_centre_on_one_half(spark):
    rows = [(1, i, i + 1, float(i), i % 7 == 0) for i in range(80)]
    nulls = temporal.permutation_nulls(spark.createDataFrame(rows, "cut int, a long, b long, score double, positive boolean"), 60)
    assert abs(nulls.agg(F.avg("auc")).first()[0] - 0.5) < 0.06 and nulls.count() == 60


def test_upsert_lets_newer_columns_win_even_if_null(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, home string")
    new = spark.createDataFrame([(1, None, 5, 2), (1, "q", 4, 1), (3, "c", 6, 1), (None, "z", 0, 9)], "id long, name string, rank long, version long")
    got = {r.id: (r.name, r.home, r["rank"]) for r in resolve.upsert(old, new, ["id"]).collect()}
    assert got == {1: (None, "x", 5), 2: ("b", "y", None), 3: ("c", None, 6)}


def test_edges_need_both_ends(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 3), ("a", "c", 1), ("d", "b", 1)], "source string, target string, version long")
    assert [tuple(r) for r in resolve.upsert_edges(edges, nodes).select("source", "target", "version").collect()] == [("a", "b", 3)]


def test_risk_scores_add_weights(spark):
    rows = [("f1", "critical", "firm", "1", 1, 0.0), ("f2", "high", "firm", "1", 1, 0.0), ("f2", "low", "office", "1", 1, 0.0), ("f3", "odd", "firm", "2", 1, 0.0)]
    df = spark.createDataFrame(rows, "flag string, severity string, entity_type string, entity_id string, n long, val double")
    got = {(r.entity_type, r.entity_id): (r.risk_score, r.n_flags, r.n_kinds) for r in flags.risk_scores(df).collect()}
    assert got == {("firm", "1"): (7, 2, 2), ("office", "1"): (1, 1, 1), ("firm", "2"): (0, 1, 1)}


def test_outliers_and_completeness(spark):
    rows = [(i, "a", 10.0 + i % 3) for i in range(40)] + [(99, "a", 500.0), (100, None, None)]
    df = spark.createDataFrame(rows, "ref long, kind string, amount double")
    assert [(r.n, r.sample_refs) for r in quality.outliers(df, "amount", "kind").collect()] == [(1, "99")]
    got = {(r.field, r.missing, r.status) for r in quality.completeness({"x": (df, ["ref", "kind"])}).collect()}
    assert got == {("ref", 0, "PASS"), ("kind", 1, "FAIL")}


def test_file_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a_1.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "a_2.jsonl").write_text('{"x": 3}\n')
    (tmp_path / "d.json").write_text(json.dumps({"k": {"v": [1, 2]}}, indent=1))
    (tmp_path / "t.csv").write_text("Reference No,Agency\n1,é\n")
    newest = files.latest(spark, f"file://{tmp_path}/a_*.jsonl")
    assert newest.endswith("a_2.jsonl") and files.latest(spark, f"file://{tmp_path}/none*") is None
    assert sorted(r.x for r in files.json_lines(spark, f"{tmp_path}/a_1.jsonl").collect()) == [1, 2]
    assert files.json_document(spark, f"{tmp_path}/d.json").select("k.v").first().v == [1, 2]
    got = files.detected(files.csv(spark, f"{tmp_path}/t.csv")).first()
    assert (got.reference_number, got.procuring_entity, got.title) == ("1", "é", None)
    files.write_json_lines(spark.range(3), f"{tmp_path}/out")
    assert files.json_lines(spark, f"{tmp_path}/out").count() == 3
    files.write_graph(spark.range(2), spark.createDataFrame([(1, 2, "T")], "s long, d long, type string"), f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/edges").where("type = 'T'").count() == 1
    assert files.parquet(spark, f"{tmp_path}/g/nodes", ["id"]).columns == ["id"]


def test_streams_count_requests_and_years(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, 'c' || id % 2 AS client FROM range(40)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = monitor.new_files(spark, f"{tmp_path}/in", rows.schema)
    query = monitor.request_counts(stream, 10).writeStream.format("memory").queryName("requests").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("SELECT max(n) AS n, bool_or(over) AS over FROM requests").first()
    assert (got.n, got.over) == (20, True)


def test_cosine_neighbours(spark):
    rnd = np.random.default_rng(1)
    m = rnd.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(5)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in resolve.cosine_top(df, df.where("id % 20 = 0"), 3).collect():
        s = u @ u[r.query]
        s[r.query] = -9
        assert r.id == int(np.argsort(-s)[r.k - 1])


def test_walks_follow_edges_and_repeat(spark):
    from awardlens.operators import embed

    edges = [(a, b, 1.0 + b % 2) for a, b in small_graph()]
    near = neighbours([(a, b) for a, b, _ in edges])
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    first = sorted(tuple(r.walk) for r in walks.random_walks(e, 8, 3).collect())
    assert len(first) == 3 * len(near) and all(len(w) == 8 for w in first)
    assert all(int(b) in near[int(a)] for w in first for a, b in itertools.pairwise(w))
    assert first == sorted(tuple(r.walk) for r in walks.random_walks(e.repartition(3), 8, 3).collect())


def test_rewiring_keeps_degrees(spark):
    from collections import Counter

    from awardlens.operators import embed

    rnd = random.Random(3)
    edges = sorted({(rnd.randrange(12), f"o{rnd.randrange(9)}") for _ in range(50)})
    got = embed.rewired(spark.createDataFrame(edges, "left long, right string"), 3).collect()
    for k in (1, 2, 3):
        own = [(r.left, r.right) for r in got if r.replicate == k]
        assert len(set(own)) == len(own) == len(edges) and set(own) != set(edges)
        assert Counter(a for a, _ in own) == Counter(a for a, _ in edges) and Counter(b for _, b in own) == Counter(b for _, b in edges)


def test_auc_of_rewired_graphs(spark):
    rnd = random.Random(8)
    firms, offices, cuts, times = range(8), [f"o{i}" for i in range(5)], (1996, 1997), 3
    known = {(c, f, o): rnd.randint(1993, c) for c in cuts for f in firms for o in offices if rnd.random() < 0.5}
    pairs = {(c, a, b): rnd.random() < 0.4 for c in cuts for a, b in itertools.combinations(firms, 2)}
    graphs = {(c, k): {(f, o) for f in firms for o in offices if rnd.random() < 0.5} for c in cuts for k in range(1, times + 1)}
    want = {}
    for (c, k), edges in graphs.items():
        degree = {o: sum(x == o for _, x in edges) for o in offices}
        fresh = lambda f, o, c=c: 2 ** (-(c - known.get((c, f, o), c)) / 2)
        score = {}
        for a, b in itertools.combinations(firms, 2):
            shared = [o for o in offices if (a, o) in edges and (b, o) in edges]
            score[a, b] = round(sum((1 / math.log(1 + degree[o])) * fresh(a, o) * fresh(b, o) for o in shared), 9)
        yes = [v for p, v in score.items() if pairs[c, *p]]
        no = [v for p, v in score.items() if not pairs[c, *p]]
        want[c, k] = sum((x > y) + (x == y) / 2 for x in yes for y in no) / (len(yes) * len(no))
    known = spark.createDataFrame([(*p, y) for p, y in known.items()], "cut int, firm long, office string, last int")
    pairs = spark.createDataFrame([(*p, y) for p, y in pairs.items()], "cut int, a long, b long, positive boolean")
    drawn = spark.createDataFrame([(c, k, *e) for (c, k), edges in graphs.items() for e in edges], "cut int, replicate long, firm long, office string")
    got = {(r.cut, r.replicate): r.auc for r in temporal.rewired_auc(pairs, known, drawn, times).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    nulls = temporal.rewired_nulls(pairs, known, times, 2).collect()
    assert {(r.cut, r.replicate) for r in nulls} == set(want)
