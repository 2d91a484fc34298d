from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from awardlens.llm import mixing as op


def worst_deviation(plan, weights):
    worst, phase, counts, n, live = 0, None, Counter(), 0, set()
    for s, _, _, ph in plan:
        if ph != phase:
            phase, counts, n = ph, Counter(), 0
            live = {x for x, _, _, q in plan if q >= ph}
        counts[s] += 1
        n += 1
        scale = sum(weights[x] for x in live)
        worst = max(worst, *(abs(counts[x] - weights[x] / scale * n) for x in live))
    return worst


def test_every_source_stays_within_one_block():
    for counts in ({"a": 500, "b": 300, "c": 7, "d": 90}, {"a": 1}, {"a": 40, "b": 40, "c": 40}, {str(i): 3 + i * i for i in range(25)}):
        weights = op.target_weights(counts)
        plan = op.schedule(counts, weights)
        assert worst_deviation(plan, weights) < 1
        assert Counter(s for s, _, _, _ in plan) == counts
        assert [slot for _, _, slot, _ in plan] == list(range(len(plan)))
        for s in counts:
            assert [k for x, k, _, _ in plan if x == s] == list(range(counts[s]))


def test_given_weights_decide_the_order():
    plan = op.schedule({"a": 6, "b": 3}, {"a": Fraction(2, 3), "b": Fraction(1, 3)})
    assert Counter(s for s, _, slot, _ in plan if slot < 3) == {"a": 2, "b": 1}
    assert op.schedule({}, {}) == []


def test_all_rows_get_a_gapless_position(spark):
    rows = [(i, f"s{i % 3 if i < 700 else 0}", i) for i in range(2000)] + [(5, "s1", 1), (5, "s1", 1), (None, None, 0), (7, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int").repartition(5)
    got = op.mixed(df, block_rows=10).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for rs in by_source.values():
        assert sorted(r.source_rank for r in rs) == list(range(len(rs)))
        assert all(r.block == r.source_rank // 10 for r in rs)
    assert [r.position for r in sorted(got, key=lambda r: (r.slot, r.source_rank))] == list(range(len(rows)))
    assert op.mixed(df.limit(0)).count() == 0
    bounded = op.mixed(df, block_rows=1, max_blocks=50).agg(F.max("slot")).first()[0]
    assert bounded < 50 + 4


def test_mixed_layout_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", f"t{i}") for i in range(300)], "doc_id long, source string, text string")
    out = op.in_mixed_order(df, block_rows=5)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def reference(blocks, weights):
    """Earliest deadline first over every block, without periods."""
    plan, slot, phase, done = [], 0, 0, dict.fromkeys(blocks, 0)
    while live := [s for s in sorted(blocks) if done[s] < blocks[s]]:
        share = {s: weights[s] / sum(weights[x] for x in live) for s in live}
        placed, now, ended = dict.fromkeys(live, 0), 0, False
        while not ended:
            s = min((s for s in live if placed[s] // share[s] <= now), key=lambda s: (-(-(placed[s] + 1) // share[s]), live.index(s)))
            plan.append((s, done[s], slot, phase))
            done[s], placed[s], slot, now = done[s] + 1, placed[s] + 1, slot + 1, now + 1
            ended = done[s] == blocks[s]
        phase += 1
    return plan


def test_periods_give_the_order_of_all_blocks():
    for counts, weights in (
        ({"a": 500, "b": 300, "c": 7, "d": 90}, {"a": 5, "b": 4, "c": 1, "d": 2}),
        ({"a": 61, "b": 60, "c": 59}, {"a": 1, "b": 1, "c": 1}),
        ({"a": 100, "b": 1, "c": 3}, {"a": 1, "b": 90, "c": 7}),
        ({str(i): 3 + i * i for i in range(12)}, {str(i): 1 + i for i in range(12)}),
    ):
        exact = {s: Fraction(w, sum(weights.values())) for s, w in weights.items()}
        assert op.schedule(counts, exact) == reference(counts, exact)


def test_blocks_keep_their_rows_and_the_plan_its_size_in_a_large_table(spark):
    counts = {"a": 900_000_000, "b": 90_000_000, "c": 9_000_001, "d": 17}
    spans, places = op._tables({s: -(-n // 16) for s, n in counts.items()}, counts, op.target_weights(counts), 16)
    assert len(places) < 4 * 10_100 and sum(len(x) for _, x in spans) <= 10
    df = spark.range(400_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    placed = op.mixed(df).groupBy("source", "block").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("slot"), F.min("position").alias("x"), F.max("position").alias("y"))
    got = placed.toPandas().sort_values("slot")
    assert got["n"].max() == got["n"].min() == 16 and set(got["slots"]) == {1}
    assert got["slot"].tolist() == list(range(25_000))
    assert got["x"].tolist() == list(range(0, 400_000, 16)) and (got["y"] - got["x"] == 15).all()
    w = op.target_weights({"sa": 360_000, "sb": 40_000})
    assert got["source"].tolist() == [s[1:] for s, _, _, _ in op.schedule({"sa": 22_500, "sb": 2_500}, w)]


def test_clashing_columns_come_back_as_they_were(spark):
    names = ["position", "_position", "_o", "_p", "block", "slot", "phase", "_s", "_b", "_h", "_r", "row", "key", "_th", "BLOCK2", "a.b"]
    rows = [(i, f"t{i}", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    assert sorted(map(tuple, op.in_mixed_order(df).collect())) == sorted(rows)
    kept = op.mixed(df)
    assert {r.position for r in kept.collect()} == set(range(60))
    assert {(r.doc_id, r["_s"], r["a.b"]) for r in kept.collect()} == {(r[0], r[10], r[18]) for r in rows}


def test_null_ids_are_spread_by_their_texts(spark):
    df = spark.createDataFrame([(None, f"t{i}", "a") for i in range(300)], "doc_id long, text string, source string")
    got = op.mixed(df).collect()
    assert sorted(r.position for r in got) == list(range(300)) and len({r.text for r in got}) == 300
