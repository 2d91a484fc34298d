"""Blocks of vectors meet their questions by a shuffle, not through the driver."""

import numpy as np

from awardlens.operators import vectors


def test_blocks_are_not_sent_through_the_driver(spark):
    rnd = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((60, 4)))], "id long, embedding array<double>")
    found = vectors.nearest(vectors.build(df, 3), df, 2, 3)
    assert found.count() == 120
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
