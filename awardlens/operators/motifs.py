"""Joint pairs of firms against the years of their shared offices, in blocks: each two blocks of firms are one task, which
holds the lists of both and looks at some of their pairs at a time, so no row is made for a pair and an office."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.operators.order import numbered
from awardlens.operators.settle import settled

#: Firms of a block at most, pairs looked at together, offices and years looked at together, at least; a code's place for years, and none.
SIZE, STRIP, CELLS, YEARS, NONE = 32_768, 4096, 1024, 65_536, 65_535


def _slabs(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of sorted codes with whole offices, each of CELLS or a little more."""
    starts = np.flatnonzero(np.r_[True, np.diff(cells // YEARS) != 0])
    top = 0
    for end in np.r_[starts[1:], len(cells)]:
        if end - top >= CELLS or end == len(cells):
            yield top, end
            top = end


class _Firms:
    """The firms of two blocks with their codes, an office and a year each, as places in a list of all codes."""

    def __init__(self, ids: list, codes: list) -> None:
        order = np.argsort(ids)
        self.ids, self.sizes = np.asarray(ids)[order], np.array([len(codes[i]) for i in order])
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.cells, places = np.unique(np.concatenate([codes[i] for i in order]), return_inverse=True)
        self.places = places.astype(np.int32)
        self.slabs = list(_slabs(self.cells))
        self.years = np.unique(self.cells % YEARS)

    def held(self, firms: np.ndarray, top: int, end: int) -> np.ndarray:
        """For each firm, which codes of a stretch it has."""
        at = np.searchsorted(self.ids, firms)
        n = self.sizes[at]
        row = np.repeat(np.arange(len(firms)), n)
        place = self.places[np.repeat(self.starts[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        mine = (place >= top) & (place < end)
        found = np.zeros((len(firms), end - top), dtype=bool)
        found[row[mine], place[mine] - top] = True
        return found

    def counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By pair and year: at how many shared offices one of the two has an award."""
        total = np.zeros((len(a), len(self.years)), dtype=np.int64)
        for top, end in self.slabs:
            offices, x, y = self.cells[top:end] // YEARS, self.held(a, top, end), self.held(b, top, end)
            first = np.flatnonzero(np.r_[True, np.diff(offices) != 0])
            both = np.logical_or.reduceat(x, first, axis=1) & np.logical_or.reduceat(y, first, axis=1)
            found = (x | y) & np.repeat(both, np.diff(np.r_[first, end - top]), axis=1)
            of_year = (self.cells[top:end] % YEARS)[:, None] == self.years[None, :]
            total += (found.astype(np.float32) @ of_year.astype(np.float32)).astype(np.int64)
        return total

    def motifs(self, pairs: pd.DataFrame) -> pd.DataFrame:
        total = self.counts(pairs["a"].to_numpy(), pairs["b"].to_numpy())
        upto = np.cumsum(total[:, self.years != NONE], axis=1)
        years, m = self.years[self.years != NONE], upto[:, -1] if upto.shape[1] else np.zeros(len(pairs), dtype=np.int64)
        mid = np.full(len(pairs), np.nan)
        some = np.flatnonzero(m)
        if len(some):
            at = lambda k: years[(upto[some] > k[:, None]).argmax(axis=1)]
            mid[some] = (at((m[some] - 1) // 2) + at(m[some] // 2)) / 2
        return pd.DataFrame({"a": pairs["a"], "b": pairs["b"], "first_joint": pairs["first_joint"], "n": total.sum(axis=1), "mid": mid})


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, ids, codes, firms = None, [], [], None
    for pdf in frames:
        for (i, j, kind), rows in pdf.groupby(["i", "j", "kind"]):
            if (i, j) != key:
                key, ids, codes, firms = (i, j), [], [], None
            if kind == 0:
                ids.extend(rows["a"])
                codes.extend(rows["codes"])
                continue
            firms = firms or _Firms(ids, codes)
            for top in range(0, len(rows), STRIP):
                yield firms.motifs(rows.iloc[top : top + STRIP])


def paired_years(joint: DataFrame, at: DataFrame, tasks: int) -> DataFrame:
    """`a, b, first_joint, n, mid`: of joint(a, b, first_joint) the pairs with offices and years that one of the two has at a shared office, their number and median year.

    at: firm (a whole number), office, year, distinct.
    """
    offices = numbered(at.select("office").distinct(), [F.col("office")], "o")
    code = F.col("o").cast("long") * YEARS + F.coalesce(F.col("year"), F.lit(NONE))
    lists = at.join(offices, "office").groupBy("firm").agg(F.collect_list(code).alias("codes"))
    lists = settled(numbered(lists, [F.col("firm")], "n"), "motif-firms")
    size = max(64, min(SIZE, -(-lists.count() // 4)))
    block = lambda c, to: lists.select(F.col("firm").alias(c), F.floor((F.col("n") - 1) / size).cast("int").alias(to))
    pairs = settled(joint.join(block("a", "i").hint("merge"), "a").join(block("b", "j").hint("merge"), "b").select("i", "j", "a", "b", "first_joint"), "motif-pairs")
    met = pairs.select("i", "j").distinct()
    both = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("of"))
    own = lists.select(F.floor((F.col("n") - 1) / size).cast("int").alias("of"), F.col("firm").alias("a"), "codes").join(F.broadcast(both), "of")  # at most a few hundred blocks meet
    none = lambda t: F.lit(None).cast(t)
    rows = own.select("i", "j", F.lit(0).alias("kind"), "a", none("long").alias("b"), none("int").alias("first_joint"), "codes").unionByName(pairs.select("i", "j", F.lit(1).alias("kind"), "a", "b", "first_joint", none("array<long>").alias("codes")))
    rows = rows.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "kind")
    return rows.mapInPandas(_run, "a long, b long, first_joint int, n long, mid double")
