"""Queries without an oracle against SQL over the whole of their input."""

import duckdb
import pytest

from awardlens.operators import graph, temporal
from awardlens.plans import catalogue, network
from awardlens.plans import temporal as temporal_plans
from awardlens.sources.tables import Domain, oracle

FOLDER = "/root/testdata/sf0.01"
PAIRS = oracle("SELECT x.firm AS src, y.firm AS dst, CAST(count(*) AS DOUBLE) AS weight, min(x.year) AS year FROM focus x JOIN focus y ON x.ref = y.ref AND x.firm < y.firm GROUP BY 1, 2")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier orders lineitem".split():
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_modularity_is_of_all_joint_focus_awards(spark, db, monkeypatch):
    want = db.sql(PAIRS).fetchall()
    assert sorted(map(tuple, network.joint_pairs(Domain(spark, FOLDER).focus).select("src", "dst", "weight", "year").collect())) == sorted(want)
    seen = []
    monkeypatch.setattr(graph, "modularity", lambda e, labels, f=graph.modularity: seen.append(e) or f(e, labels))
    assert catalogue.queries()["community_modularity"](spark, FOLDER).count() == 1
    assert sorted(map(tuple, seen[0].select("src", "dst", "weight", "year").collect())) == sorted(want)


def test_link_nulls_are_of_all_focus_contracts_and_500_orders(spark, db, monkeypatch):
    whole = temporal_plans._LINK
    want = sorted(db.sql(oracle("SELECT CAST(cut AS INT) AS cut, a, b, score, positive FROM cand", whole)).fetchall())
    seen = []
    monkeypatch.setattr(temporal, "permutation_nulls", lambda rows, times, f=temporal.permutation_nulls: seen.append((rows, times)) or f(rows, times))
    catalogue.queries()["temporal_link_nulls"](spark, FOLDER).collect()
    rows, times = seen[0]
    assert times == 500
    got = sorted(map(tuple, rows.select("cut", "a", "b", "score", "positive").collect()))
    assert [(c, a, b, p) for c, a, b, _, p in got] == [(c, a, b, p) for c, a, b, _, p in want]
    assert all(abs(x[3] - y[3]) < 1e-8 for x, y in zip(got, want, strict=True))


def test_office_graphs_are_of_all_large_firms_and_years(spark, db):
    from awardlens.plans import structure

    want = db.sql(oracle("""SELECT y, a, b, CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT year AS y FROM focus) JOIN (SELECT x.firm AS a, z.firm AS b, greatest(x.s, z.s) AS since FROM first x JOIN first z ON x.office = z.office AND x.firm < z.firm) ON since <= y
     GROUP BY 1, 2, 3 HAVING count(*) >= 2""", f"large AS (SELECT firm FROM focus GROUP BY 1 HAVING sum(amount) >= {temporal_plans.LARGE}), first AS (SELECT firm, office, min(year) AS s FROM focus SEMI JOIN large USING (firm) GROUP BY 1, 2)")).fetchall()
    got = structure.shared_office_graphs(Domain(spark, FOLDER)).select("graph", "src", "dst", "weight").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_louvain_is_no_worse_than_label_propagation(spark):
    found = {r.method: r.modularity for r in catalogue.queries()["community_quality"](spark, FOLDER).collect()}
    assert found["louvain"] >= found["label propagation"] and found["louvain"] > 0
