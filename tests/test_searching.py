"""Search over the written index against a scan of all entities."""

import random

import pytest
from pyspark.sql import functions as F

from awardlens.operators import searching


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slack(t):
    return 0 if len(t) <= 3 else 1 if len(t) <= 6 else 2


def near(t, words):
    best = min((0 if w.startswith(t) else distance(w, t) for w in words), default=99)
    return best if best <= slack(t) else None


def scan(entities, question):
    tokens, exact, like = question.split(), [], []
    if not tokens:
        return []
    for id_, label, aliases, value in entities:
        hay = " ".join([label, *aliases])
        if all(t in hay for t in tokens):
            rank = 0 if label == question else 1 if label.startswith(question) else 2 if question in label else 3
            exact.append((rank, -value, id_, False))
        else:
            edits = [near(t, hay.split()) for t in tokens]
            if None not in edits:
                like.append((sum(edits), -value, id_, True))
    found = sorted(exact) + (sorted(like) if len(exact) < 8 else [])
    return [(i + 1, id_, similar, rank) for i, (rank, _, id_, similar) in enumerate(found[:40])]


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_are_those_of_a_scan(spark, seed):
    rng = random.Random(seed)
    stems = ["sunwest", "builder", "north", "river", "ab", "abc", "road", "works", "a", "trade", "traders"]

    def word():
        w = rng.choice(stems)
        at = rng.randrange(len(w))
        return rng.choice([w, w, w[:at] + w[at + 1 :] or "z", w[:at] + "x" + w[at:], w[::-1]])

    entities = [(f"e{i}", " ".join(word() for _ in range(rng.choice([1, 2, 3]))), [" ".join(word() for _ in range(rng.choice([1, 2]))) for _ in range(rng.choice([0, 1, 2]))], float(rng.randrange(5))) for i in range(150)]
    questions = [" ".join(word() for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(60)] + ["", "a a", "zzzzzzz", "uil", "rive nort"]
    df = spark.createDataFrame([(i, lab.title(), [(a.upper() + "!", "name") for a in al], v) for i, lab, al, v in entities], "id string, label string, aliases array<struct<text:string,kind:string>>, value double")
    asked = spark.createDataFrame(list(enumerate(questions)), "q int, text string")
    got = {}
    for r in searching.search(searching.build(df), asked).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.place, r.id, r.similar, r["rank"]))
    assert got == {q: want for q, text in enumerate(questions) if (want := scan(entities, text))}


def test_reasons_name_the_alias_that_matched(spark):
    df = spark.createDataFrame([("1", "Sunwest, Inc", [("Elizaldy \"Zaldy\" Co", "name"), ("Old Name Builders", "former"), ("OLD name builders", "former")], 1.0), ("2", None, None, None)], "id string, label string, aliases array<struct<text:string,kind:string>>, value double")
    asked = spark.createDataFrame([(1, "zaldy"), (2, "sunwest"), (3, "bilders old"), (4, "co inc")], "q int, text string")
    got = {r.q: (r.id, r.similar, r["rank"], r.reason_kind, r.reason) for r in searching.search(searching.build(df), asked).collect()}
    assert got == {1: ("1", False, 3, "name", 'Elizaldy "Zaldy" Co'), 2: ("1", False, 1, None, None), 3: ("1", True, 1, "former", "Old Name Builders"), 4: ("1", False, 3, "name", 'Elizaldy "Zaldy" Co')}


def test_forms_with_characters_left_out(spark):
    [row] = spark.range(1).select(searching.left_out(F.lit("abc")).alias("two"), searching.left_out(F.lit("a")).alias("short")).collect()
    assert sorted(row.two) == ["a", "ab", "abc", "ac", "b", "bc", "c"] and sorted(row.short) == ["", "a"]


def test_the_limit_comes_before_the_kinds(spark):
    rows = [(f"A:{i}", "east end", [], 0.0) for i in range(3)] + [("B:1", "eastern", [], 0.0), ("B:2", "east", [], 0.0)]
    index = searching.build(spark.createDataFrame(rows, "id string, label string, aliases array<struct<text:string,kind:string>>, value double"))
    assert [r.id for r in searching.fulltext(index, "East", limit=10).orderBy("id").collect()] == ["A:0", "A:1", "A:2", "B:1", "B:2"]
    assert [r.id for r in searching.fulltext(index, "eas", ("B",), 1).collect()] == ["B:1"]
    assert searching.fulltext(index, " ").count() == 0
