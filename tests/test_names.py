"""Like names against all pairs, and names of persons."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.operators import resolve


def hostile_names(seed, n):
    rng = random.Random(seed)
    words = ["ACME", "DELTA", "BUILDERS", "CONSTRUCTION", "WORKS", "INC", "ABC", "XYZ", "SAN", "JOSE", "AAAA", "ABAB", "J", "ROAD", "BRIDGE", "Ñ", "TRADING"]
    names = {"ABCD", "ABCDEFGHIJ", "ACME", "ACME BUILDER", "DELTA", "DELTA WORKS INC", "A", "AB", "BA", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", ""}
    while len(names) < n:
        name = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 5])))
        kind = rng.randrange(5)
        at = rng.randrange(len(name))
        if kind == 0:
            name = name[:at] + rng.choice("ABCDEÑ") + name[at:]
        elif kind == 1:
            name = name[:at] + name[at + 1 :]
        elif kind == 2 and len(name) > 2:
            at = min(at, len(name) - 2)
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
        elif kind == 3:
            name = "".join(rng.choice("ABCD") for _ in range(rng.randrange(1, 9)))
        names.add(name)
    return sorted(names)


@pytest.mark.parametrize(("n", "least"), [(1500, 0.85), (300, 0.72), (300, 0.92)])
def test_no_pair_of_all_is_lost(spark, n, least):
    names = hostile_names(n, n)
    rows = resolve.fuzzy_matches(spark.createDataFrame([(x,) for x in names] * 2, "name string"), least).collect()
    got = {(r.a, r.b): r.similarity for r in rows}
    assert len(got) == len(rows)
    db = duckdb.connect()
    db.register("n", pd.DataFrame({"name": [x for x in names if x and x.isascii()]}))
    want = dict(((a, b), s) for a, b, s in db.sql(f"SELECT * FROM (SELECT x.name AS a, y.name AS b, round(jaro_winkler_similarity(x.name, y.name), 6) AS s FROM n x JOIN n y ON x.name < y.name) WHERE s >= {least}").fetchall())
    assert {k: v for k, v in got.items() if k[0].isascii() and k[1].isascii()} == want
    wide = [x for x in names if x and not x.isascii()]
    slow = {(a, b) for a in wide for b in names if b and (a < b or b.isascii()) and a != b and round(resolve._jaro_winkler(*sorted((a, b))), 6) >= least}
    assert {tuple(sorted(k)) for k in slow} == {k for k in got if not (k[0].isascii() and k[1].isascii())}


def test_short_names_that_are_beginnings_of_long_ones_are_found(spark):
    names = ["ABCD", "ABCDEFGHIJ", "ACME", "ACME BUILDER", "DELTA", "DELTA WORKS INC"]
    got = {(r.a, r.b) for r in resolve.fuzzy_matches(spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert got == {("ABCD", "ABCDEFGHIJ"), ("ACME", "ACME BUILDER"), ("DELTA", "DELTA WORKS INC")}


def test_names_of_persons(spark):
    names = {"Peña, José de las Alas III": "PEÑA, JOSÉ DELAS ALAS", " maria DE  LA cruz, Jr. ": "MARIA DELA CRUZ", "Li Wei 李伟": "LI WEI 李伟", "Juan del  Rosario SR.": "JUAN DEL ROSARIO", None: "", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "n string, want string")
    assert df.where(fn.person_name(F.col("n")) != F.col("want")).count() == 0
