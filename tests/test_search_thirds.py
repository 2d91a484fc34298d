"""Words near a token are found by the thirds of a word: every pair in reach, and three rows for a word."""

import random

from pyspark.sql import functions as F

from awardlens.operators import searching
from awardlens.plans import lookup
from awardlens.sources.tables import Domain


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_no_near_word_is_lost(spark):
    rng = random.Random(3)

    def edited(w):
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abc0") + w[at:], w[:at] + rng.choice("abc0") + w[at + 1 :]])
        return w

    words = ["".join(rng.choice("abc0") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["000000012", "aaaaaaa", "ab"]
    tokens = sorted({edited(w) for w in words for _ in range(3)} - {""})
    index = searching.build(spark.createDataFrame([(str(i), w, None, 0.0) for i, w in enumerate(words)], "id string, label string, aliases array<struct<text:string,kind:string>>, value double"))
    slack = lambda t: 0 if len(t) <= 3 else 1 if len(t) <= 6 else 2
    got = {(r.token, r.word) for r in searching._near(index, spark.createDataFrame([(0, t) for t in tokens], "q int, token string")).collect()}
    assert got == {(t, w) for t in tokens for w in set(words) if slack(t) and distance(t, w) <= slack(t)}


def test_index_has_three_rows_for_a_word_and_one_for_an_end(spark):
    index = searching.build(spark.createDataFrame([("1", "supplier 000000012 ab", None, 0.0)], "id string, label string, aliases array<struct<text:string,kind:string>>, value double"))
    assert index.segments.count() == 6
    assert index.beginnings.count() == 8 + 9 + 2


def test_officials_need_no_orders_and_awards_are_read_once(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    held = spark.createDataFrame([(1, 2)], "firm long, amount long")
    plan = lookup.entities(d, held)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderdate" not in plan and "l_orderkey" not in plan
    people = lookup.entities(d, held).where(F.col("id").startswith("Person:"))
    assert people.count() == d.officials.count()


def test_answers_take_the_awards_once_as_sums_by_office_and_firm(spark, monkeypatch):
    seen = []
    settled = lookup.settled
    monkeypatch.setattr(lookup, "settled", lambda df, purpose: seen.append((purpose, df.columns)) or settled(df, purpose))
    d = Domain(spark, "/root/testdata/sf0.001")
    answers = lookup.answer_blocks(d)
    assert seen[0] == ("held", ["office", "firm", "c", "amount"]) and not d._held
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
