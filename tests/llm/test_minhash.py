import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from awardlens.llm import minhash as op
from awardlens.llm.text import shingles

SCHEMA = "doc_id long, text string"


def corpus():
    rnd = random.Random(3)
    rows = [(5, None), (2, ""), (9, "x"), (4, "ünï cödé 漢字 text"), (-3, "one two three")]
    for k in range(60):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(1, 300))]
        rows.append((100 + 7 * k, " ".join(base)))
    return rows


def test_report_matches_brute_force_over_many_ranges(spark):
    rows = corpus()
    order = sorted((i, t or "") for i, t in rows)
    got = {r.doc_id: r for r in op.successor_report(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert len(got) == len(rows)
    sig = dict(zip([i for i, _ in order], op.signatures([t.encode() for _, t in order]), strict=True))
    for k, (i, t) in enumerate(order):
        j, after = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        new = op.signatures([edited.encode()])[0]
        assert r.near_edited == float((sig[i] == new).mean()) and r.near_next == float((sig[i] == sig[j]).mean())
        assert r.fingerprint == sig[i].astype(">u4").tobytes().hex() and r.edited_fingerprint == new.astype(">u4").tobytes().hex()


def test_ties_null_ids_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c d"), (1, "a")], SCHEMA)
    got = op.successor_report(df).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got) == [1, 1, 1, 3]
    one = op.successor_report(spark.createDataFrame([(7, "ab cd")], SCHEMA)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(7, 1.0)]
    assert op.successor_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_likeness_estimates_jaccard():
    rnd = random.Random(1)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(3000)]
    copy = base[:2000] + [f"u{i}" for i in range(1000)]
    a, b = op.signatures([" ".join(base).encode(), " ".join(copy).encode()])
    assert abs((a == b).mean() - 1996 / (2996 * 2 - 1996)) < 0.2


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(6)
    rows, shingle_sets = [], {}
    for k in range(25):
        base = [f"w{rnd.randrange(4000)}" for _ in range(120)]
        for j in range(3):
            copy = list(base)
            if j:
                copy[rnd.randrange(120)] = f"z{k}{j}"
            rows.append((10 * k + j, " ".join(copy)))
        rows.append((10 * k + 3, " ".join(base)))
    for i, t in rows:
        w = t.split()
        shingle_sets[i] = {tuple(w[n : n + 5]) for n in range(len(w) - 4)}
    leaders, want = [], {}
    for i, _ in rows:
        reached = [j for j in leaders if len(shingle_sets[j] & shingle_sets[i]) >= 0.8 * len(shingle_sets[j] | shingle_sets[i])]
        want[i] = min(reached, default=i)
        leaders += [i] if not reached else []
    got = {r.doc_id: r.class_id for r in op.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and len(set(want.values())) < len(rows) / 2


def test_near_duplicates_of_nulls_repeats_and_an_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (None, "alone"), (3, None), (4, "")]
    got = [(r.doc_id, r.class_id) for r in op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (None, 5), (None, None), (3, 3), (4, 3)], key=str)
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingles_of_short_texts():
    h, n = shingles([b"", b"a b", b"A B", b"a b c d e f"], 5)
    assert n.tolist() == [0, 1, 1, 2] and h[0] == h[1] and len(np.unique(h)) == 3


def test_clashing_columns_change_nothing(spark):
    rows = [(i, f"some words of text number {i % 3} and more of them") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = df.withColumns({"T": F.lit(1), "a.b": F.lit(2), "part": F.lit(3), "Fingerprint": F.lit(4), "k": F.lit(5), "hash": F.lit(6), "node": F.lit(7)})
    for work in (op.successor_report, op.near_duplicates):
        assert sorted(map(tuple, work(more).collect())) == sorted(map(tuple, work(df).collect()))
