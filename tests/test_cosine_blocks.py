"""Nearest vectors for more queries than a block holds."""

import numpy as np

from awardlens.operators import resolve


def test_cosine_neighbours_of_more_queries_than_a_block(spark):
    rnd = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((90, 6)))], "id long, embedding array<double>").repartition(3)
    found = lambda **block: {(r["query"], r.id, r.similarity, r.k) for r in resolve.cosine_top(df, df, 4, **block).collect()}
    whole = found()
    assert len(whole) == 90 * 4 and found(block=20) == whole
    assert resolve.cosine_top(df, df.limit(0), 4).count() == 0


def test_over_4096_queries_have_results(spark):
    rnd = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((4200, 4)))], "id long, embedding array<double>").repartition(4)
    got = resolve.cosine_top(df, df, 1)
    assert got.count() == got.select("query").distinct().count() == 4200
