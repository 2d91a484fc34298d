import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from awardlens.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", digest, text or ""))
    return {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])
        out[c] = base[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        todo, all_of = [k], []
        while todo:
            x = todo.pop()
            all_of.append(x)
            todo += kids.get(x, [])
        return all_of

    out = set()
    for k, members in nodes.items():
        sub = below(k)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].split()) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, n, words=("a b", "c", "", "d e f", "a  b\t")):
    rng = random.Random(seed)
    return [(c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice(words)) for c in rng.sample(range(-40, 400), n) for k in range(rng.choice([1, 1, 2, 3, 4, 6]))]


@pytest.mark.parametrize(("seed", "n", "parts"), [(1, 120, "1"), (2, 150, "7"), (3, 60, "40"), (4, 200, "13")])
def test_nodes_match_brute_force_whatever_the_parts(spark, seed, n, parts):
    rows = random_rows(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(p.trie(df)) == brute(turns_of(rows))
        assert found(p.rebuilt_trie(df)) == brute(rebuilt(turns_of(rows)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies_and_long_paths_over_many_parts(spark):
    rows = [(c, k, "user", f"w{k} x" if k < 30 or c % 3 else f"own {c}") for c in range(90) for k in range(40)]
    rows += [(1000 + c, 0, "user", "same first") for c in range(200)] + [(5000, k, "user", f"deep {k % 7}") for k in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert found(p.trie(spark.createDataFrame(rows, SCHEMA))) == brute(turns_of(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nulls_ties_repeats_extra_columns_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, None, ""), (None, 0, "user", "lost"), (-5, 3, "x", "y z"), (40, 0, "user", "q")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"Depth": F.lit(1), "a.b": F.lit(1), "KEY": F.lit(2), "base": F.lit(3)})
    assert found(p.trie(df)) == brute(turns_of(rows))
    assert found(p.rebuilt_trie(df)) == brute(rebuilt(turns_of(rows)))
    assert p.rebuilt_trie(df.limit(0)).count() == 0


def test_large_border_tables_are_joined_by_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(p, "BROADCAST_ROWS", 0)
    rows = random_rows(9, 100)
    assert found(p.trie(spark.createDataFrame(rows, SCHEMA))) == brute(turns_of(rows))


def test_turnless_conversations_end_at_the_root(spark):
    ids = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    rows = [(c, 0, "user", "gone") for c in ids]
    want = brute(rebuilt(turns_of(rows)))
    assert len(want) == 1
    assert found(p.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == want
