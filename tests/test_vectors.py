"""The inverted file against the exact way, and walks against the weights of edges."""

import collections

import numpy as np
from pyspark.sql import functions as F

from awardlens.operators import resolve, vectors, walks


def clouds(n=600, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    return [(int(i), (centres[i % 12] + rng.normal(size=dims)).tolist()) for i in range(n)]


def test_recall_rises_to_one_with_the_cells_that_are_read(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    v = spark.createDataFrame([*clouds(), (9000, [0.0] * 16), (9001, None)], "id long, embedding array<double>")
    asked = v.where("id % 50 = 0 AND id < 600")
    zero = vectors.nearest(vectors.build(v, 4), v.where("id = 9000"), 3, 4).collect()  # a vector of zeros is a question like others
    assert [(r.id, r.similarity) for r in sorted(zero, key=lambda r: r.k)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    exact = resolve.cosine_top(v.where("embedding IS NOT NULL"), asked, 5)
    index = vectors.build(v, 20)
    assert index.rows == 601 and index.blocks.agg(F.sum(F.size("ids"))).first()[0] == 601
    assert index.blocks.groupBy("cell").count().where("count > 1").count() > 0  # large cells are several rows
    recall = [vectors.measured_recall(vectors.nearest(index, asked, 5, p), exact) for p in (1, 6, 20)]
    assert recall[0] <= recall[1] <= recall[2] and recall[1] >= 0.9 and recall[2] >= 0.99
    probes = vectors.probes_for(index, asked, exact, 5)
    assert vectors.measured_recall(vectors.nearest(index, asked, 5, probes), exact) >= 0.95
    rows = vectors.nearest(index, asked, 5, 20).collect()
    assert all(r.query != r.id for r in rows) and collections.Counter(r["query"] for r in rows) == {i: 5 for i in range(0, 600, 50)}


def test_registered_index_reaches_its_recall(spark):
    from awardlens.plans import catalogue

    folder = "/root/testdata/sf0.01"
    found = catalogue.queries()["vector_cells_topk"](spark, folder)
    assert vectors.measured_recall(found, catalogue.queries()["vector_cosine_topk"](spark, folder)) >= 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert vectors.nearest(vectors.build(none), none, 5, 3).count() == 0


def chances(levels):
    """Of each neighbour of each node, from the tables alone."""
    tables = [{(r.src, r.block): r for r in t.collect()} for t in levels]
    out = collections.Counter()

    def go(level, src, block, chance):
        r = tables[level][(src, block)]
        for item, keep, other in zip(r["items"], r["keep"], r["other"], strict=True):
            for target, part in ((item, keep), (other, 1 - keep)):
                if part > 0:
                    p = chance * part / len(r["items"])
                    if level:
                        go(level - 1, src, target, p)
                    else:
                        out[(src, target)] += p

    for src, block in tables[-1]:
        go(len(tables) - 1, src, block, 1.0)
    return out


def test_tables_of_hubs_give_each_edge_its_weight(spark, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK", 4)
    rng = np.random.default_rng(1)
    edges = [(0, i, float(rng.integers(1, 9))) for i in range(1, 120)] + [(5, 6, 2.0), (5, 7, 1.0), (6, 7, 0.0)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    levels = walks.block_tables(e)
    assert len(levels) >= 3 and all(t.agg(F.max(F.size("items"))).first()[0] < 30 for t in levels)
    weight = collections.Counter()
    for a, b, w in edges:
        weight[(a, b)] += w
        weight[(b, a)] += w
    total = collections.Counter()
    for (a, _), w in weight.items():
        total[a] += w
    got = chances(levels)
    assert got.keys() == {k for k, w in weight.items() if w} and all(abs(got[k] - weight[k] / total[k[0]]) < 1e-9 for k in got)
    steps = [tuple(map(int, r.walk)) for r in walks.random_walks(e, 7, 2).collect()]
    assert len(steps) == 2 * 120 and all(len(w) == 7 and all(weight[p] > 0 for p in zip(w, w[1:], strict=False)) for w in steps)


def test_walkers_follow_the_weights(spark):
    e = spark.createDataFrame([(0, 1, 6.0), (0, 2, 3.0), (0, 3, 1.0)], "src long, dst long, weight double")
    seen = collections.Counter(r.walk[1] for r in walks.random_walks(e, 2, 3000).where("walk[0] = '0'").collect())
    assert abs(seen["1"] / 3000 - 0.6) < 0.05 and abs(seen["2"] / 3000 - 0.3) < 0.05


def test_alias_tables_keep_all_weight():
    for weights in ([1.0], [1, 1, 1], [5, 1, 1, 1], [0.1, 100, 3, 3, 7]):
        w = np.array(weights, dtype=float)
        keep, other = walks.alias_table(w.copy())
        got = np.bincount(np.r_[np.arange(len(w)), other], np.r_[keep, 1 - keep], len(w)) / len(w)
        assert np.allclose(got, w / w.sum())
