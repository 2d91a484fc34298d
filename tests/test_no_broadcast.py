"""Joins of nodes in growing graphs and components go by shuffles: none pass through the driver."""

from awardlens.operators import graph, growth
from awardlens.operators.settle import settled


def test_forest_and_components_send_no_nodes_through_the_driver(spark, monkeypatch):
    plans = []

    def noted(df, purpose):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return settled(df, purpose)

    for module in (graph, growth):
        monkeypatch.setattr(module, "settled", noted)
    rows = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1990 + i % 5) for i in range(40)], "src string, dst string, year int")
    assert [tuple(r) for r in growth.replay(rows).orderBy("year").collect()][-1] == (1994, 41, 40, 41)
    assert {p for p, _ in plans} >= {"forest-hooks", "forest-jumps", "forest-edges", "component-labels"}
    assert not [p for p, plan in plans if "Broadcast" in plan and p.startswith(("forest", "component-labels"))]
