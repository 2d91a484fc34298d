"""A task holds the similarities of few queries at a time."""

import numpy as np

from awardlens.operators import resolve


def test_queries_are_compared_in_strips(spark, monkeypatch):
    widths, real = [], np.round

    def noted(x, *args):
        widths.append(np.shape(x)[-1])
        return real(x, *args)

    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)], "id long, embedding array<double>").repartition(2)
    kept = {}
    frame = type(df)
    run_as = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema: kept.setdefault("f", f) and run_as(self, f, schema))
    resolve.cosine_top(df, df, 3).count()
    monkeypatch.setattr(np, "round", noted)
    found = list(kept["f"](iter([df.toPandas()])))
    assert max(widths) == resolve.QUERY_STRIP < 300 and sum(map(len, found)) == 900
