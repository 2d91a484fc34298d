"""Joint pairs and the years of their shared offices, in blocks, against plain Python."""

import random
import statistics

import numpy as np
import pandas as pd

from awardlens.operators import motifs, temporal
from awardlens.sources import tables
from awardlens.plans import network


def plain(pairs, held):
    found = {}
    for a, b, since in pairs:
        shared = {o for o, _ in held[a]} & {o for o, _ in held[b]}
        years = [y for o, y in held[a] | held[b] if o in shared]
        known = [y for y in years if y is not None]
        if years:
            found[a, b] = (since, len(years), statistics.median(known) if known else None)
    return found


def test_pairs_of_many_blocks_have_their_years(spark):
    rnd = random.Random(3)
    held = {f: {(f"O{rnd.randrange(30)}", rnd.choice([*range(1990, 2000), None])) for _ in range(rnd.randrange(1, 12))} for f in range(1, 301)}
    pairs = [(a, b, rnd.randrange(1990, 2000)) for a, b in {tuple(sorted(rnd.sample(range(1, 301), 2))) for _ in range(900)}]
    at = spark.createDataFrame([(f, o, y) for f, s in held.items() for o, y in s], "firm long, office string, year int")
    rows = motifs.paired_years(spark.createDataFrame(pairs, "a long, b long, first_joint int"), at, 5).where("n > 0").collect()
    assert {(r.a, r.b): (r.first_joint, r.n, r.mid) for r in rows} == plain(pairs, held)
    assert len(rows) > 300


def test_stretches_of_codes_add_up(monkeypatch):
    monkeypatch.setattr(motifs, "CELLS", 3)
    rnd = random.Random(4)
    held = {f: {(rnd.randrange(9), rnd.randrange(1990, 1996)) for _ in range(15)} for f in range(20)}
    pairs = [(a, b, 1990) for a in range(20) for b in range(a + 1, 20)]
    firms = motifs._Firms(list(held), [np.array([o * motifs.YEARS + y for o, y in s]) for s in held.values()])
    assert len(firms.slabs) > 2
    got = firms.motifs(pd.DataFrame(pairs, columns=["a", "b", "first_joint"]))
    assert {(r.a, r.b): (r.first_joint, r.n, r.mid) for r in got[got["n"] > 0].itertuples()} == plain(pairs, held)


def test_pairs_of_firms_go_to_tasks_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 500)
    d = tables.Domain(spark, "/root/testdata/sf0.001")
    assert network.focus_pairs(d).rdd.getNumPartitions() == d.tasks == temporal.motifs(d.focus, d.focus.select("firm").distinct(), d.tasks).rdd.getNumPartitions()
