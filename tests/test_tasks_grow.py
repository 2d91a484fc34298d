"""What is as long as the lines is dealt to more tasks as the tables grow."""

from awardlens.plans import network
from awardlens.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_bids_and_their_pairs_go_to_tasks_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 500)
    d = tables.Domain(spark, FOLDER)
    lines = d.table("lineitem").count()
    assert d.tasks == -(-lines // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert d.bids.rdd.getNumPartitions() == d.tasks
    assert network.co_bidding_edges(d).rdd.getNumPartitions() == d.tasks
