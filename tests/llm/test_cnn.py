import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from awardlens.llm import cnn


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(("an", "er", "the", "on", "ti", "re")) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 400))]
        good = i % 3 != 0
        if not good:
            at = rnd.randrange(len(words))
            words[at:] = [w.upper() + "!!" if i % 2 else w + "***" for w in words[at:]] or ["X!!"]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy_and_bounds(spark):
    rows = corpus(500, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9001, None, 0.1), (9002, "", 0.2), (None, "abc", 0.3), (1, rows[1][1], 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None)], "doc_id long, quality int")
    got = cnn.classified(docs, labels).collect()
    assert len(got) == 504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert cnn.scored(docs.limit(0), cnn.Network.fresh(0).tabulate()).count() == 0


def test_without_labels_scores_are_the_share(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in cnn.classified(docs, none).collect()] == [0.5]


def test_a_text_does_not_change_its_neighbours_scores():
    net = cnn.Network.fresh(4).tabulate()
    texts = [b"", b"x", b"short text", b"y" * 3000, bytes(range(256)) * 9, "é漢".encode() * 700]
    together = cnn.probabilities(net, texts)
    alone = np.concatenate([cnn.probabilities(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)


def test_every_byte_is_seen():
    net = cnn.Network.fresh(2).tabulate()
    text = bytearray(b"a" * 5000)
    before = cnn.pooled(net, [bytes(text)])
    for at in (0, 2500, 4999):
        changed = bytearray(text)
        changed[at] = ord("!")
        assert not np.array_equal(cnn.pooled(net, [bytes(changed)]), before)


@pytest.mark.parametrize("name", ["e", "w", "b", "a", "a0", "o", "o0"])
def test_gradients_match_differences(name):
    net = cnn.Network.fresh(7)
    for k, v in net.weights().items():
        setattr(net, k, v.astype(np.float64))
    net.tabulate()
    net.table = np.einsum("vd,kdf->kvf", net.e, net.w)
    text = b"the quick brown fox jumps over the lazy dog " * 30

    def loss():
        net.table = np.einsum("vd,kdf->kvf", net.e, net.w)
        return -np.log(cnn.probabilities(net, [text])[0])

    grad = cnn._gradients(net, text, 1, 1.0)[name]
    w = getattr(net, name)
    flat = np.argsort(-np.abs(grad).ravel())[:3]
    for i in flat:
        at = np.unravel_index(i, w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-2 * max(1, abs(grad[at]))


def direct(net, text):
    """The probability of one text by loops over its bytes."""
    n = max(1, -(-len(text) // cnn.STRIDE))
    data = text + bytes(cnn.STRIDE * n + cnn.WIDTH - len(text))
    out = [[sum(float(net.e[data[cnn.STRIDE * i + k]] @ net.w[k, :, f]) for k in range(cnn.WIDTH)) for f in range(cnn.FILTERS)] for i in range(n)]
    seg = [[max(r[f] for r in out[a : a + cnn.SEGMENT]) for f in range(cnn.FILTERS)] for a in range(0, n, cnn.SEGMENT)]
    chunks = [[max(x, y) for x, y in zip(a, b)] for a, b in zip(seg, seg[1:])] or seg
    v = [max(s[f] for s in seg) + net.b[f] for f in range(cnn.FILTERS)]
    v += [sum(c[f] for c in chunks) / len(chunks) + net.b[f] for f in range(cnn.FILTERS)]
    v += [min(c[f] for c in chunks) + net.b[f] for f in range(cnn.FILTERS)]
    hidden = np.tanh(np.array([*v, np.log(n) - 5]) @ net.a + net.a0)
    return 1 / (1 + np.exp(-(hidden @ net.o + net.o0)[0]))


def test_scores_match_loops_over_bytes_whatever_the_slice(monkeypatch):
    net = cnn.Network.fresh(3).tabulate()
    rnd = random.Random(2)
    texts = [b"", b"a", bytes(rnd.randrange(256) for _ in range(513)), b"plain words " * 150, "é漢".encode() * 400]
    want = [direct(net, t) for t in texts]
    assert np.allclose(cnn.probabilities(net, texts), want, atol=1e-4)
    monkeypatch.setattr(cnn, "SLICE", cnn.SEGMENT * cnn.STRIDE)
    assert np.allclose(cnn.probabilities(net, texts), want, atol=1e-4)


def test_long_and_repeated_labelled_texts_are_learned_from(spark):
    rows = corpus(60, 5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, 0), (7, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, "short"), (2, None)], "doc_id long, text string")
    a = cnn.train(docs, labels, train_rows=40)
    b = cnn.train(docs.repartition(7), labels.repartition(5), train_rows=40)
    assert all(np.array_equal(x, b.weights()[k]) for k, x in a.weights().items())


def test_gradients_of_slices_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(32, 120, 9000).astype(np.uint8).tobytes()
    net = cnn.Network.fresh(5).tabulate()
    whole = cnn._gradients(net, text, 1, 1.0)
    monkeypatch.setattr(cnn, "SLICE", cnn.STRIDE * cnn.SEGMENT * 2)
    monkeypatch.setattr(cnn, "ROWS_AT_ONCE", 3)
    sliced = cnn._gradients(net, text, 1, 1.0)
    assert all(np.allclose(whole[k], sliced[k], atol=1e-5) for k in whole)


def test_scores_beside_any_columns(spark):
    net = cnn.Network.fresh(2).tabulate()
    df = spark.createDataFrame([(1, "a text", 5), (2, None, 6)], "doc_id long, text string, SCORE int").withColumns({"a.b": F.lit(1), "row": F.lit(2), "_Score": F.lit(3), "x`y": F.lit(4)})
    out = cnn.scored(df, net)
    assert out.columns == ["doc_id", "text", "a.b", "row", "_Score", "x`y", "score"]
    assert [(r.doc_id, r["a.b"], r["x`y"]) for r in out.orderBy("doc_id").collect()] == [(1, 1, 4), (2, 1, 4)]
