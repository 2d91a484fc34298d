"""Winners, and the pairs and partners of their firms, are dealt to more tasks as the tables grow."""

from awardlens.operators import graph
from awardlens.plans import views
from awardlens.sources import tables


def test_awards_and_partners_go_to_tasks_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 500)
    d = tables.Domain(spark, "/root/testdata/sf0.001")
    assert d.winners.rdd.getNumPartitions() == d.tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = []

    def ranked(pairs, n, tasks=None):
        seen.append((pairs.rdd.getNumPartitions(), tasks))
        return graph_ranked(pairs, n, tasks)

    graph_ranked = graph.ranked_neighbours
    monkeypatch.setattr(graph, "ranked_neighbours", ranked)
    views.search_rows(d)
    assert seen == [(d.tasks, d.tasks)]
