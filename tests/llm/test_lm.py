import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from awardlens.llm import lm

SCHEMA = "doc_id long, text string"


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choice(words[: 3 + i % 28]) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (502, "Unseen WORDS w1  w2\n w1"), (503, "W1 w1")]


def tokens(text):
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    train = [tokens(t) for i, t in rows if not held(i)]
    uni = collections.Counter(w for t in train for w in t)
    triple = collections.Counter(p for t in train for p in zip(["</s>", "</s>", *t], ["</s>", *t], t, strict=False))
    pair = collections.Counter((b, c) for _, b, c in triple)
    cont = collections.Counter(w for _, w in pair)

    def discounts(values):
        return lm._discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])

    f, d, e = discounts(triple.values()), discounts(pair.values()), discounts(cont.values())
    cut = lambda c, x: max(c - (0, *x)[min(c, 3)], 0)
    n, v, types = sum(uni.values()), len(uni), len(pair)
    rest = sum(e[min(c, 3) - 1] for c in cont.values()) / types
    total, left, whole, stored = (collections.Counter() for _ in range(4))
    for (a, _), c in pair.items():
        total[a] += c
        left[a] += d[min(c, 3) - 1]
    for (a, b, _), c in triple.items():
        whole[a, b] += c
        if c >= lm.STORED:
            stored[a, b] += cut(c, f)

    def p(a, b, w):
        word = cut(cont[w], e) / types + rest / (v + 1)
        two = (cut(pair[b, w], d) + left[b] * word) / total[b] if total[b] else word
        if not stored[a, b]:
            return two
        c = triple[a, b, w]
        return ((cut(c, f) if c >= lm.STORED else 0) + (whole[a, b] - stored[a, b]) * two) / whole[a, b]

    out = {}
    for i, t in rows:
        tok = tokens(t)
        past = zip(["</s>", "</s>", *tok], ["</s>", *tok], tok, strict=False)
        out[i] = (held(i), len(tok), sum(uni[w] > 0 for w in tok), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tok), sum(math.log10(p(*x)) for x in past))
    return out, p, [*uni, "never-seen"]


def check(spark, rows):
    want, _, _ = brute(rows)
    got = lm.held_out_scores(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert np.allclose((r.base_score, r.score), want[r.doc_id][4:], rtol=1e-9)


def test_scores_match_brute_force(spark):
    check(spark, corpus())


@pytest.mark.parametrize("hot", [2000, 60])
def test_many_shards_and_spread_words_give_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    monkeypatch.setattr(lm, "HOT_COUNT", hot)
    check(spark, corpus())
    model = lm.train(spark.createDataFrame(corpus(), SCHEMA))
    assert (len(model.hot) > 3) == (hot == 60)


def test_small_blocks_and_counts_above_a_byte(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 300)
    check(spark, [*corpus(), *((1000 + i, "w1 w2 w1 w2 rare" + str(i % 7)) for i in range(500))])


def test_probabilities_sum_to_one():
    _, p, words = brute(corpus())
    for a, b in (("w1", "w2"), ("</s>", "w1"), ("</s>", "</s>"), ("w3", "never-seen"), ("never-seen", "w1")):
        assert abs(sum(p(a, b, w) for w in words) - 1) < 1e-9


def test_a_repeated_passage_scores_above_its_words_shuffled(spark):
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(200)]
    passage = " ".join(rnd.choice(words) for _ in range(80))
    rows = [(i, " ".join(rnd.choice(words) for _ in range(80))) for i in range(200)]
    free = [i for i in range(1000, 1100) if held(i)]
    rows += [(300, passage), (301, passage), (302, passage), (free[0], passage), (free[1], " ".join(sorted(passage.split())))]
    got = {r.doc_id: r.score for r in lm.held_out_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[free[0]] > got[free[1]] + 80


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.held_out_scores(empty).count() == 0
    only = [i for i in range(60) if held(i)][:2]
    got = lm.held_out_scores(spark.createDataFrame([(i, "a b") for i in only], SCHEMA)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_clashing_columns_change_nothing(spark):
    rows = [(i, f"the text of number {i % 5} and the rest of the text") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = df.withColumns({"T": F.lit(1), "a.b": F.lit(2), "bucket": F.lit(3), "Keys": F.lit(4), "n_tokens": F.lit(5), "SCORE": F.lit(6)})
    tell = lambda d: sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.held_out_scores(d).collect())
    assert tell(more) == tell(df)
