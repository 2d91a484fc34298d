"""Pairs of members that share items, in blocks: the pairs of two blocks of members are one task's, some rows of their matrix at a time.

Members are numbered in their order and cut in blocks. What a block's members hold is packed in one row for a group, and that row goes
to the tasks of the block with each other one; no row is shuffled for an item and two blocks, or for a single pair. A task adds up the
products of a strip of rows at a time: items that most members have as one product of matrices, the others place by place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.operators.order import numbered
from awardlens.operators.settle import settled

#: Members of a block at most, and what they hold in all; cells of a strip; places looked at together.
SIZE, HELD, CELLS, PLACES = 8192, 1 << 22, 1 << 18, 1 << 21
#: Tasks of a group at most.
TASKS = 256

PAIRS = "grp long, a long, b long, score double, common long, next boolean"
PACKED = "grp long, of int, items binary, counts binary, at binary, x binary, u binary, ids binary"


class _Half:
    """A block: its items in order with their weights, and the places of the members that hold each."""

    def __init__(self, r, size: int) -> None:
        self.items, self.counts, self.at = np.frombuffer(r.items, np.int64), np.frombuffer(r.counts, np.int32).astype(np.int64), np.frombuffer(r.at, np.uint16).astype(np.int64)
        self.x, self.u = np.frombuffer(r.x, np.float64) if len(r.x) else None, np.frombuffer(r.u, np.float64) if r.u else None
        if r.u is None:
            us = dict(r.us)
            self.u = np.array([us[i] for i in self.items.tolist()])
        self.ids = np.frombuffer(r.ids, np.int64) if r.ids is not None else None
        self.own = np.frombuffer(r.own, np.float64).reshape(size, -1) if getattr(r, "own", None) is not None else None
        self.starts = np.cumsum(self.counts) - self.counts


class _Pair:
    """Two blocks of a group. Rows are members of the first, columns those of the second."""

    def __init__(self, r, size: int, high: int, scored: bool) -> None:
        self.grp, self.size, self.high, self.same = r.grp, size, high, r.i == r.j
        self.left = self.right = None
        self.scored, self.at = scored, 0

    def ready(self) -> None:
        """Places of the first block's items in the second, by its members."""
        left, right = self.left, self.right
        place = np.minimum(np.searchsorted(right.items, left.items), len(right.items) - 1)
        place = np.where(right.items[place] == left.items, place, -1)
        order = np.argsort(left.at, kind="stable")
        item = np.repeat(np.arange(len(left.items)), left.counts)[order]
        met = place[item] >= 0
        self.row, self.item = left.at[order][met], item[met]
        self.place = place[self.item]
        self.first = np.searchsorted(self.row, np.arange(self.size + 1))
        one = np.ones(len(self.row))
        self.w = (left.u[self.item] if left.u is not None else one) * (left.x[order][met] if left.x is not None else one)
        self.weighted = left.u is not None or left.x is not None or right.x is not None
        heavy = np.flatnonzero(4 * right.counts > self.size)
        self.heavy = np.full(len(right.items), -1)
        self.heavy[heavy] = np.arange(len(heavy))
        self.n_heavy = len(heavy)
        own = np.repeat(self.heavy, right.counts)
        self.dense = np.zeros((len(heavy), self.size), np.float32)
        self.dense[own[own >= 0], right.at[own >= 0]] = 1
        if self.scored and self.weighted and len(heavy):
            self.dense_x = self.dense.astype(np.float64)
            if right.x is not None:
                self.dense_x[own[own >= 0], right.at[own >= 0]] = right.x[own >= 0]

    def _parts(self, here: np.ndarray) -> Iterator[tuple]:
        """Some of the first block's entries with their rows' counterparts: entry of each, and place among the second block's entries."""
        n = self.right.counts[self.place[here]]
        upto = np.cumsum(n)
        cuts = np.searchsorted(upto, np.arange(PLACES, upto[-1] + PLACES, PLACES), "left") + 1 if len(n) else []
        top = 0
        for end in cuts:
            some, m = here[top:end], n[top:end]
            if len(some):
                before = np.cumsum(m) - m
                yield np.repeat(some, m), np.repeat(self.right.starts[self.place[some]] - before, m) + np.arange(m.sum())
            top = end

    def closed(self, k: int, linked: np.ndarray) -> Iterator[tuple]:
        """(item, row's id, column's id) where the two are linked, for the rows of a strip."""
        top = k * self.high
        for entry, of in self._parts(np.arange(self.first[top], self.first[min(self.size, top + self.high)])):
            row, column = self.row[entry], self.right.at[of]
            found = linked[row - top, column]
            if found.any():
                yield self.left.items[self.item[entry[found]]], self.left.ids[row[found]], self.right.ids[column[found]]

    def sums(self, k: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Score and number of common items (or no number) of the pairs of a strip."""
        top, end = k * self.high, min(self.size, (k + 1) * self.high)
        here = np.arange(self.first[top], self.first[end])
        cells = (end - top) * self.size
        dense = self.heavy[self.place[here]] >= 0
        common, score = np.zeros((end - top, self.size), np.float32), None
        scored = self.scored and self.weighted
        counted = counted or not scored
        if self.n_heavy:
            flat = np.zeros((end - top, self.n_heavy), np.float32)
            some = here[dense]
            cell = (self.row[some] - top, self.heavy[self.place[some]])
            flat[cell] = 1
            common = flat @ self.dense if counted else None
            if scored:
                weights = np.zeros(flat.shape)
                weights[cell] = self.w[some]
                score = weights @ self.dense_x
            here = here[~dense]
        common = common.astype(np.int64).ravel() if counted else None
        if scored:
            score = np.zeros(cells) if score is None else score.ravel()
        for entry, of in self._parts(here):
            cell = (self.row[entry] - top) * self.size + self.right.at[of]
            if counted:
                common += np.bincount(cell, minlength=cells)
            if scored:
                score += np.bincount(cell, self.w[entry] if self.right.x is None else self.w[entry] * self.right.x[of], minlength=cells)
        common = common.reshape(-1, self.size) if counted else None
        return score.reshape(-1, self.size) if scored else common, common

    def strip(self, k: int, since: np.ndarray | None, least: int) -> Strip:
        score, common = self.sums(k)
        found = common >= least
        if since is not None:
            found &= since > self.grp
        if self.same:
            found &= np.arange(self.size)[None, :] > np.arange(k * self.high, k * self.high + len(found))[:, None]
        return Strip(self, k * self.high, score, common, found, since)


class Strip:
    """Some rows of two blocks' matrix: which pairs are open, their scores and common items; members' ids and own numbers."""

    def __init__(self, pair: _Pair, top: int, score: np.ndarray, common: np.ndarray, found: np.ndarray, since: np.ndarray | None) -> None:
        self.pair, self.top, self.grp, self.score, self.common, self.found, self.since = pair, top, pair.grp, score, common, found, since

    def own(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """A number of the rows' members, as a column, and of the columns' members."""
        return self.pair.left.own[self.top : self.top + len(self.found), c][:, None], self.pair.right.own[:, c][None, :]

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the rows' members and of the columns' members."""
        return self.pair.left.own[self.top : self.top + len(self.found)], self.pair.right.own

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows' members and of the columns' members; none is in a pair where a block ends before."""
        return self.pair.left.ids[self.top : self.top + len(self.found)], self.pair.right.ids

    def at(self, found: np.ndarray | None = None) -> tuple:
        """Places of pairs (the open ones) in the strip, and the ids of their two members."""
        r, c = np.nonzero(self.found if found is None else found)
        return r, c, self.pair.left.ids[self.top + r], self.pair.right.ids[c]

    def fresh(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.since[r, c] == self.grp + 1 if self.since is not None else np.zeros(len(r), dtype=bool)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does, halves away from zero; values are not negative."""
    return np.floor(values * 10.0**digits + 0.5) / 10.0**digits


def _rows_in(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in frames:
        yield from pdf.itertuples(index=False)


def _linked(r, pair: _Pair) -> np.ndarray:
    since = np.full((min(pair.size, (r.strip + 1) * pair.high) - r.strip * pair.high, pair.size), np.inf)
    since[np.asarray(r.pa) - r.strip * pair.high, r.pb] = r.since
    return since


def _strips(frames: Iterator[pd.DataFrame], size: int, high: int, scored: bool, least: int = 1) -> Iterator[tuple]:
    """(strip, known scores) of each two blocks, from rows in the order of their keys."""
    key, pair, of, known = None, None, None, []

    def rest(end: int) -> Iterator[tuple]:
        if pair is None or pair.left is None or pair.right is None:
            return
        if pair.at == 0:
            pair.ready()
        for k in range(pair.at, end):
            yield pair.strip(k, None, least), known
        pair.at = end

    n = -(-size // high)
    for r in _rows_in(frames):
        if (r.grp, r.task, r.i, r.j) != key:
            yield from rest(n)
            key, pair = (r.grp, r.task, r.i, r.j), None
            if (r.grp, r.task) != of:
                of, known = (r.grp, r.task), []
        if r.kind == 0:
            known.append(r.known)
            continue
        pair = pair or _Pair(r, size, high, scored)
        if r.kind == 1:
            pair.left = _Half(r, size)
            pair.right = pair.left if pair.same else None
        elif r.kind == 2:
            pair.right = _Half(r, size)
        elif pair.left is not None and pair.right is not None:
            yield from rest(r.strip)
            if pair.at == 0:
                pair.ready()
            yield pair.strip(r.strip, _linked(r, pair), least), known
            pair.at = r.strip + 1
    yield from rest(n)


def _pack(size: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "at"])
        items, first, counts = np.unique(pdf["item"].to_numpy(), return_index=True, return_counts=True)
        x, u, ids = pdf["x"].to_numpy(), pdf["u"].to_numpy()[first], np.zeros(size, np.int64)
        ids[pdf["at"].to_numpy()] = pdf["member"].to_numpy()
        kept = lambda v: [v.tobytes() if (v != 1).any() else b""]
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "of": [pdf["of"].iloc[0]], "items": [items.astype(np.int64).tobytes()], "counts": [counts.astype(np.int32).tobytes()], "at": [pdf["at"].to_numpy().astype(np.uint16).tobytes()], "x": kept(x), "u": kept(u), "ids": [ids.tobytes()]})

    return run


def _pack_own(size: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.stack(pdf["own"].to_numpy())
        table = np.zeros((size, own.shape[1]))
        table[pdf["at"].to_numpy()] = own
        return pd.DataFrame({"of": [pdf["of"].iloc[0]], "own": [table.tobytes()]})

    return run


def _rows(held: DataFrame, links: DataFrame | None, known: DataFrame | None = None, own: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """The rows of all tasks, each task's together and in order, the size of a block and the rows of a strip."""
    held = settled(held, "block-held")
    members = settled(numbered(held.select("member").distinct(), [F.col("member")], "n"), "block-members")
    n, most = members.count(), held.count()
    size = min(SIZE, max(256, min(n // 16, HELD * n // max(1, most))))
    high = max(1, min(size, CELLS // size))
    blocks = max(1, -(-n // size))
    tasks = min(TASKS, blocks * (blocks + 1) // 2)
    task = lambda i, j: F.pmod(F.xxhash64(i, j), F.lit(tasks))
    place = lambda m: members.select(F.col("member").alias(m), F.floor((F.col("n") - 1) / size).cast("int").alias(f"of_{m}"), ((F.col("n") - 1) % size).cast("int").alias(f"at_{m}"))
    if dict(held.dtypes)["item"] not in ("bigint", "int"):
        names = numbered(held.select("item").distinct(), [F.col("item")], "m")
        held = held.join(names, "item").withColumn("item", F.col("m").cast("long"))
    entries = held.join(place("member"), "member").select(F.col("grp").cast("long").alias("grp"), F.col("of_member").alias("of"), F.col("at_member").alias("at"), "item", F.col("member").cast("long").alias("member"), F.col("x").cast("double").alias("x"), F.col("u").cast("double").alias("u"))
    packed = settled(entries.groupBy("grp", "of").applyInPandas(_pack(size), PACKED), "block-lists")
    if own is None:
        packed = packed.withColumn("own", F.lit(None).cast("binary"))
    else:
        owned = own.join(place("member"), "member").select(F.col("of_member").alias("of"), F.col("at_member").alias("at"), F.col("own").cast("array<double>").alias("own"))
        packed = packed.join(owned.groupBy("of").applyInPandas(_pack_own(size), "of int, own binary"), "of")
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    blob = ("items", "counts", "at", "x", "u", "ids", "own")
    head = lambda kind, strip: [F.col("grp").cast("long").alias("grp"), task("i", "j").alias("task"), "i", "j", F.lit(kind).alias("kind"), strip.cast("int").alias("strip")]
    plain = [none("array<int>", "pa"), none("array<int>", "pb"), none("array<double>", "since")]
    ends = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    side = lambda kind, i, j, fits: packed.withColumn("other", ends).where(fits).withColumn("i", i).withColumn("j", j).select(*head(kind, F.lit(0)), *blob, *plain, none("array<double>", "known"))
    rows = side(1, F.col("of"), F.col("other"), F.col("other") >= F.col("of")).unionByName(side(2, F.col("other"), F.col("of"), F.col("other") < F.col("of")))
    if links is not None:
        at = links.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "since").join(place("a"), "a").join(place("b"), "b")
        linked = at.groupBy("grp", F.col("of_a").alias("i"), F.col("of_b").alias("j"), F.floor(F.col("at_a") / high).alias("k")).agg(F.collect_list(F.struct("at_a", "at_b", F.col("since").cast("double").alias("since"))).alias("s"))
        cut = lambda c: F.transform("s", lambda v: v[c])
        rows = rows.unionByName(linked.select(*head(3, F.col("k")), *(none("binary", c) for c in blob), cut("at_a").alias("pa"), cut("at_b").alias("pb"), cut("since").alias("since"), none("array<double>", "known")))
    if known is not None:
        parts = known.groupBy("grp", F.pmod(F.xxhash64("a", "b"), F.lit(64)).alias("part")).agg(F.collect_list("score").alias("known"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task")
        rows = rows.unionByName(parts.select(F.col("grp").cast("long").alias("grp"), each, F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("kind"), F.lit(0).alias("strip"), *(none("binary", c) for c in blob), *plain, "known"))
    return rows.repartition(2 * tasks, "grp", "task").sortWithinPartitions("grp", "task", "i", "j", "kind", "strip"), size, high


def found_pairs(held: DataFrame, links: DataFrame | None, make: Callable, schema: str, least: int = 1, scored: bool = False, own: DataFrame | None = None) -> DataFrame:
    """What `make` gives for the strips of a task: an iterator of `Strip` to frames of `schema`.

    held, links: as for `open_pairs`; open are pairs with at least so many common items. own: member, own (numbers that strips give for their members).
    """
    rows, size, high = _rows(held, links, None, own)
    return rows.mapInPandas(lambda frames: make(strip for strip, _ in _strips(frames, size, high, scored, least)), schema)


def _pairs(only_next: bool) -> Callable:
    def make(strips: Iterator[Strip]) -> Iterator[pd.DataFrame]:
        for s in strips:
            r, c, a, b = s.at()
            if len(r):
                fresh = s.fresh(r, c)
                rows = pd.DataFrame({"grp": s.grp, "a": a, "b": b, "score": s.score[r, c].astype(np.float64), "common": s.common[r, c], "next": fresh})
                yield rows[fresh] if only_next else rows

    return make


def open_pairs(held: DataFrame, links: DataFrame | None = None, only_next: bool = False, least: int = 1) -> DataFrame:
    """`grp, a, b, score, common, next` (a < b): pairs of members with a common item (or so many) and no link up to their group's number.

    held: grp, item, member (whole numbers), x, u, one row for each item and member of a group. The score is the sum of u * x * x over common items.
    links: grp, a, b, since: a pair is left out where since <= grp, and is `next` where since = grp + 1; with `only_next` others are left out.
    """
    return found_pairs(held, links, _pairs(only_next), PAIRS, least, True)


def sharing_pairs(held: DataFrame, links: DataFrame | None, least: int, names: tuple[str, str, str] = ("a", "b", "shared")) -> DataFrame:
    """Two members and the number of their common items: the open pairs with so many; one group."""

    def make(strips: Iterator[Strip]) -> Iterator[pd.DataFrame]:
        for s in strips:
            r, c, a, b = s.at()
            yield pd.DataFrame(dict(zip(names, (a, b, s.common[r, c]), strict=True)))

    return found_pairs(held, links, make, ", ".join(f"{c} long" for c in names), least)


def met_members(held: DataFrame, links: DataFrame | None, flags: DataFrame, least: int = 1) -> DataFrame:
    """`member`: those asked for that have an open pair, of so many common items, with a member of the front; one group.

    flags: member, front, asked (booleans). No pair leaves its task.
    """
    own = flags.select("member", F.array(F.col("front").cast("double"), F.col("asked").cast("double")).alias("own"))

    def make(strips: Iterator[Strip]) -> Iterator[pd.DataFrame]:
        found = np.zeros(0, dtype=np.int64)
        for s in strips:
            (front_a, front_b), (asked_a, asked_b), (a, b) = s.own(0), s.own(1), s.ids()
            columns = (s.found & (front_a > 0)).any(axis=0) & (asked_b[0] > 0)
            rows = (s.found & (front_b > 0)).any(axis=1) & (asked_a[:, 0] > 0)
            found = np.unique(np.concatenate((found, a[rows], b[columns])))
        yield pd.DataFrame({"member": found})

    return found_pairs(held, links, make, "member long", least, own=own).distinct()


def _kept(best: pd.DataFrame | None, more: pd.DataFrame, n: int) -> pd.DataFrame:
    rows = more if best is None else pd.concat([best, more])
    return rows.sort_values(["rank", "a", "b"], ascending=[False, True, True]).head(n)


def best_pairs(held: DataFrame, links: DataFrame | None, rate: Callable, n: int, least: int = 1, own: DataFrame | None = None) -> DataFrame:
    """`a, b, common, rank, n_all`: of the open pairs that `rate` keeps the n of highest rank, ties by a and b, and how many it keeps; one group.

    rate: a `Strip` to the ranks of all its pairs and the pairs kept (or None: the open ones). Each task gives n pairs at most.
    """

    def make(strips: Iterator[Strip]) -> Iterator[pd.DataFrame]:
        best, total = None, 0
        for s in strips:
            rank, found = rate(s)
            found = s.found if found is None else found
            total += int(np.count_nonzero(found))
            if best is not None and len(best) == n:
                found = found & (rank >= best["rank"].iloc[-1])
            r, c, a, b = s.at(found)
            if len(r) > n:
                high = rank[r, c]
                some = high >= np.partition(high, -n)[-n]
                r, c, a, b = r[some], c[some], a[some], b[some]
            if len(r):
                best = _kept(best, pd.DataFrame({"a": a, "b": b, "common": s.common[r, c], "rank": rank[r, c].astype(np.float64)}), n)
        if total:
            yield pd.DataFrame({"a": [-1], "b": [-1], "common": [0], "rank": [np.nan], "n": [total]})
            yield best.assign(n=0)

    found = settled(found_pairs(held, links, make, "a long, b long, common long, rank double, n long", least, False, own), "best-pairs")  # n rows for each task
    total = found.agg(F.sum("n").alias("n_all"))  # one row
    return found.where("NOT isnan(rank)").orderBy(F.desc("rank"), "a", "b").limit(n).select("a", "b", "common", "rank").crossJoin(F.broadcast(total))


def closed_pairs(held: DataFrame, links: DataFrame) -> DataFrame:
    """`a, b, c` in order: every item (a whole number here) with two of its members that are linked. One group; x and u are not looked at."""
    rows, size, high = _rows(held, links)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pair = None, None
        for r in _rows_in(frames):
            if (r.i, r.j) != key:
                key, pair = (r.i, r.j), _Pair(r, size, high, False)
            if r.kind == 1:
                pair.left = _Half(r, size)
                pair.right = pair.left if pair.same else None
            elif r.kind == 2:
                pair.right = _Half(r, size)
            elif pair.left is not None and pair.right is not None:
                if not pair.at:
                    pair.ready()
                    pair.at = 1
                for item, a, b in pair.closed(r.strip, _linked(r, pair) < np.inf):
                    found = np.sort(np.stack([item, a, b]), axis=0)
                    yield pd.DataFrame({"a": found[0], "b": found[1], "c": found[2]})

    return rows.mapInPandas(run, "a long, b long, c long")


class _Marks:
    """Sorted numbers, and for others how many of them lie above: told by a table of even steps, where none of the numbers lies in the step."""

    def __init__(self, marks: np.ndarray, most: int = 1 << 22) -> None:
        self.marks = np.sort(marks)
        n = len(self.marks)
        self.steps = 1 << int(np.clip(np.ceil(np.log2(32 * max(1, n))), 10, np.log2(most)))
        self.low = self.marks[0] if n else 0.0
        self.scale = (self.steps - 2) / max(self.marks[-1] - self.low, 1e-300) if n else 0.0
        own = self._step(self.marks)
        held = np.bincount(own, minlength=self.steps)
        self.above = 2 * (n - np.cumsum(held))
        self.above[held > 0] = -1

    def _step(self, values: np.ndarray) -> np.ndarray:
        return np.clip((values - self.low) * self.scale + 1, 0, self.steps - 1).astype(np.int32)

    def twice(self, values: np.ndarray) -> int:
        """Pairs of a number and a value below it, counted twice, and of equal ones, counted once."""
        if not len(self.marks) or not len(values):
            return 0
        above = self.above[self._step(values)]
        near = values[above < 0]
        exact = 2 * len(near) * len(self.marks) - int(np.searchsorted(self.marks, near, "left").sum() + np.searchsorted(self.marks, near, "right").sum())
        return int(above.sum()) + len(near) + exact


def _counts(size: int, high: int, digits: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, key, sums = None, None, None
        for s, known in _strips(frames, size, high, True):
            if marks is None or marks[0] is not known:
                marks = (known, _Marks(np.round(np.concatenate(known), digits)) if known else _Marks(np.zeros(0)))
            if key != s.grp:
                if sums:
                    yield pd.DataFrame([sums], columns=["grp", "n", "n_pos", "twice"])
                key, sums = s.grp, [s.grp, 0, 0, 0.0]
            r, c, _, _ = s.at()
            fresh = s.fresh(r, c)
            sums[1] += len(r)
            sums[2] += int(fresh.sum())
            sums[3] += marks[1].twice(np.round(s.score[r, c][~fresh], digits))
        if sums:
            yield pd.DataFrame([sums], columns=["grp", "n", "n_pos", "twice"])

    return run


def open_auc(held: DataFrame, links: DataFrame, digits: int = 9) -> DataFrame:
    """`grp, n, n_pos, auc`: how well the open pairs' scores, to so many digits, tell those that are `next`.

    The scores of `next` pairs are made first and go to every task, which counts the other pairs below them; no pair leaves its task.
    """
    fresh = settled(open_pairs(held, links, True).select("grp", "a", "b", F.round("score", digits).alias("score")), "next-pairs")
    rows, size, high = _rows(held, links, fresh)
    sums = rows.mapInPandas(_counts(size, high, digits), "grp long, n long, n_pos long, twice double").groupBy("grp").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), F.sum("twice").alias("twice"))
    n_neg = F.col("n") - F.col("n_pos")
    return sums.where((F.col("n_pos") > 0) & (n_neg > 0)).select("grp", "n", "n_pos", F.round(F.col("twice") / 2 / (F.col("n_pos") * n_neg), 6).alias("auc"))


# ------------------------------------------------------------------ the open pairs, scored on many graphs

#: Members of a block at most, graphs that a task looks at together, tasks of a group and such graphs at most.
BROAD, CHUNK, FEW = 2048, 10, 4
#: Steps of the tables of `_Marks` there, at most: a task holds one for each graph.
NARROW = 1 << 18


def _pack_lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of a graph from a row for each member: its place, items and weights, and the weights of all items."""
    item, x = np.concatenate(pdf["items"].to_numpy()).astype(np.int64), np.concatenate(pdf["xs"].to_numpy())
    at = np.repeat(pdf["at"].to_numpy(), pdf["items"].map(len).to_numpy())
    order = np.lexsort((at, item))
    items, counts = np.unique(item, return_counts=True)
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "rep": [pdf["rep"].iloc[0]], "of": [pdf["of"].iloc[0]], "items": [items.tobytes()], "counts": [counts.astype(np.int32).tobytes()], "at": [at[order].astype(np.uint16).tobytes()], "x": [x[order].tobytes()]})


class _Nulls:
    """Two blocks: their open pairs, and both blocks in some graphs."""

    def __init__(self, r, size: int, high: int) -> None:
        self.seen, self.size, self.high, self.reps = _Pair(r, size, high, False), size, high, {}

    def ready(self) -> None:
        for pair in (self.seen, *self.reps.values()):
            if pair.left is not None and pair.right is not None:
                pair.ready()

    def strip(self, k: int, since: np.ndarray | None) -> Iterator[tuple]:
        """(graph, scores of pairs that are next, of the other open ones) of a strip."""
        s = self.seen.strip(k, since, 1)
        fresh = s.found & (since == s.grp + 1) if since is not None else np.zeros_like(s.found)
        others = s.found & ~fresh
        for rep, pair in self.reps.items():
            if pair.left is None or pair.right is None:
                yield rep, np.zeros(int(fresh.sum())), np.zeros(int(others.sum()))
            else:
                score = pair.sums(k, False)[0]
                yield rep, score[fresh], score[others]


def _null_strips(frames: Iterator[pd.DataFrame], size: int, high: int, only_next: bool) -> Iterator[tuple]:
    """(grp, graph, scores of pairs that are next, of the others, known scores by graph), from rows in the order of their keys; with `only_next` of strips with links alone."""
    key, of, known, now, at = None, None, {}, None, 0
    n = -(-size // high)

    def rest(end: int) -> Iterator[tuple]:
        nonlocal at
        if now is None or now.seen.left is None or now.seen.right is None:
            return
        if at == 0:
            now.ready()
        for k in range(at, 0 if only_next else end):
            for found in now.strip(k, None):
                yield now.seen.grp, *found, known
        at = max(at, end)

    for r in _rows_in(frames):
        if (r.grp, r.chunk, r.task, r.i, r.j) != key:
            yield from rest(n)
            key, now, at = (r.grp, r.chunk, r.task, r.i, r.j), None, 0
            if (r.grp, r.chunk, r.task) != of:
                of, known = (r.grp, r.chunk, r.task), {}
        if r.kind == 0:
            known.setdefault(r.rep, []).append(r.known)
            continue
        now = now or _Nulls(r, size, high)
        pair = now.seen if r.rep == 0 else now.reps.setdefault(r.rep, _Pair(r, size, high, True))
        if r.kind == 1:
            pair.left = _Half(r, size)
            pair.right = pair.left if pair.same else pair.right
        elif r.kind == 2:
            pair.right = _Half(r, size)
        elif now.seen.left is not None and now.seen.right is not None:
            if at == 0:
                now.ready()
            yield from rest(r.strip)
            for found in now.strip(r.strip, _linked(r, now.seen)):
                yield now.seen.grp, *found, known
            at = r.strip + 1
    yield from rest(n)


def _null_rows(held: DataFrame, links: DataFrame, graphs: DataFrame, weights: DataFrame) -> tuple[Callable, int, int]:
    """The rows of all tasks with known scores (or none), the size of a block and the rows of a strip."""
    members = settled(numbered(held.select("member").distinct(), [F.col("member")], "n"), "block-members")
    n = members.count()
    size = min(BROAD, max(64, -(-n // 4)))
    high, blocks = max(1, min(size, CELLS // size)), max(1, -(-n // size))
    tasks = min(FEW, blocks * (blocks + 1) // 2)
    place = lambda m: members.select(F.col("member").alias(m), F.floor((F.col("n") - 1) / size).cast("int").alias(f"of_{m}"), ((F.col("n") - 1) % size).cast("int").alias(f"at_{m}"))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    names = numbered(held.select("item").distinct(), [F.col("item")], "m")
    entries = held.join(names, "item").join(place("member"), "member").select(F.col("grp").cast("long").alias("grp"), F.col("of_member").alias("of"), F.col("at_member").alias("at"), F.col("m").cast("long").alias("item"), F.col("member").cast("long").alias("member"), F.lit(1.0).alias("x"), F.lit(1.0).alias("u"))
    base = entries.groupBy("grp", "of").applyInPandas(_pack(size), PACKED)
    lists = graphs.join(place("member"), "member").select("grp", "rep", F.col("of_member").alias("of"), F.col("at_member").alias("at"), "items", "xs")
    many = lists.groupBy("grp", "rep", "of").applyInPandas(_pack_lists, "grp long, rep long, of int, items binary, counts binary, at binary, x binary").join(F.broadcast(weights), "grp")  # a row for a group
    many = settled(many, "null-lists")
    reps = settled(many.select("grp", "rep").distinct(), "null-graphs")
    chunk = F.floor((F.col("rep") - 1) / CHUNK)
    chunks = reps.select("grp", chunk.alias("chunk")).distinct()
    blob, rest = ("items", "counts", "at", "x", "u", "ids"), [none("array<int>", "pa"), none("array<int>", "pb"), none("array<double>", "since")]
    head = lambda kind, strip: [F.col("grp").cast("long").alias("grp"), F.col("chunk").cast("long").alias("chunk"), F.pmod(F.xxhash64("i", "j"), F.lit(tasks)).alias("task"), "i", "j", F.lit(kind).alias("kind"), F.col("rep").cast("long").alias("rep"), strip.cast("int").alias("strip")]
    every = base.join(F.broadcast(chunks), "grp").withColumn("rep", F.lit(0).cast("long")).withColumn("us", F.lit(None).cast("map<bigint,double>"))
    packed = settled(every.select("grp", "chunk", "rep", "of", *blob, "us").unionByName(many.select("grp", chunk.alias("chunk"), "rep", "of", "items", "counts", "at", "x", none("binary", "u"), none("binary", "ids"), "us")), "null-blocks")
    ends = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    side = lambda kind, i, j, fits: packed.withColumn("other", ends).where(fits).withColumn("i", i).withColumn("j", j).select(*head(kind, F.lit(0)), *blob, "us", *rest, none("array<double>", "known"))
    rows = side(1, F.col("of"), F.col("other"), F.col("other") >= F.col("of")).unionByName(side(2, F.col("other"), F.col("of"), F.col("other") < F.col("of")))
    at = links.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "since").join(place("a"), "a").join(place("b"), "b")
    linked = at.groupBy("grp", F.col("of_a").alias("i"), F.col("of_b").alias("j"), F.floor(F.col("at_a") / high).alias("k")).agg(F.collect_list(F.struct("at_a", "at_b", F.col("since").cast("double").alias("since"))).alias("s"))
    cut = lambda c: F.transform("s", lambda v: v[c])
    linked = linked.join(F.broadcast(chunks), "grp").withColumn("rep", F.lit(0))
    empty = [*(none("binary", c) for c in blob), none("map<bigint,double>", "us")]
    rows = rows.unionByName(linked.select(*head(3, F.col("k")), *empty, cut("at_a").alias("pa"), cut("at_b").alias("pb"), cut("since").alias("since"), none("array<double>", "known")))
    shards = 2 * tasks * max(1, chunks.count())

    def dealt(known: DataFrame | None = None) -> DataFrame:
        every = rows
        if known is not None:
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task")
            every = rows.unionByName(known.select("grp", chunk.cast("long").alias("chunk"), each, F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("kind"), "rep", F.lit(0).alias("strip"), *empty, *rest, "known"))
        return every.repartition(shards, "grp", "chunk", "task").sortWithinPartitions("grp", "chunk", "task", "i", "j", "kind", "rep", "strip")

    return dealt, size, high


def null_auc(held: DataFrame, links: DataFrame, graphs: DataFrame, weights: DataFrame, digits: int = 9) -> DataFrame:
    """`grp, rep, auc`: on each graph, how well the scores of the pairs open in `held` (as for `open_pairs`) tell those that are `next`.

    graphs: grp, rep (from 1), member, items (whole numbers), xs. weights: grp, us (the weight of each item). A pair's score on a graph is the
    sum of u * x * x over common items, zero without any. No pair is written; of the scores only those of `next` pairs leave their tasks.
    """

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for grp, rep, fresh, _, _ in _null_strips(frames, size, high, True):
            if len(fresh):
                yield pd.DataFrame({"grp": [grp], "rep": [rep], "known": [np.round(fresh, digits)]})

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_, marks, sums = None, {}, {}
        for grp, rep, fresh, others, known in _null_strips(frames, size, high, False):
            if known is not held_:
                held_, marks = known, {}
            if rep not in marks:
                marks[rep] = _Marks(np.concatenate(known[rep]) if rep in known else np.zeros(0), NARROW)
            own = sums.setdefault((grp, rep), [0, 0, 0])
            own[0] += len(fresh)
            own[1] += len(others)
            own[2] += marks[rep].twice(np.round(others, digits))
        yield pd.DataFrame([(*k, *v[:2], float(v[2])) for k, v in sums.items()], columns=["grp", "rep", "n_pos", "n_neg", "twice"])

    dealt, size, high = _null_rows(held, links, graphs, weights)
    known = settled(dealt().mapInPandas(first, "grp long, rep long, known array<double>"), "next-scores")
    sums = dealt(known).mapInPandas(second, "grp long, rep long, n_pos long, n_neg long, twice double").groupBy("grp", "rep").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.sum("twice").alias("twice"))
    return sums.where("n_pos > 0 AND n_neg > 0").select("grp", "rep", F.round(F.col("twice") / 2 / (F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


# ------------------------------------------------------------------ given pairs, scored on many graphs

#: Members of a block at most, since every graph's lists are sent once for each block they meet; items with long lists multiplied together.
WIDE, DEEP = 2048, 64


class _Block:
    """Sums of two blocks: `score`, the number of common items, the links, and the members' ids."""

    def __init__(self, size: int, same: bool) -> None:
        self.size, self.same = size, same
        self.score, self.common, self.since = np.zeros((size, size)), np.zeros((size, size), dtype=np.int32), None
        self.a, self.b = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.deep = []

    def add(self, u, pa, ida, xa, pb, idb, xb) -> None:
        self.a[pa], self.b[pb] = ida, idb
        if 4 * min(len(pa), len(pb)) > self.size:
            self.deep.append((u, pa, xa, pb, xb))
            if len(self.deep) == DEEP:
                self.flush()
            return
        at = np.ix_(pa, pb)
        self.score[at] += np.outer(u * xa, xb)
        self.common[at] += 1

    def flush(self) -> None:
        if not self.deep:
            return
        left, right = np.zeros((len(self.deep), self.size)), np.zeros((len(self.deep), self.size))
        one, two = np.zeros(left.shape, dtype=np.float32), np.zeros(left.shape, dtype=np.float32)
        for k, (u, pa, xa, pb, xb) in enumerate(self.deep):
            left[k, pa], right[k, pb], one[k, pa], two[k, pb] = u * xa, xb, 1, 1
        self.score += left.T @ right
        self.common += (one.T @ two).astype(np.int32)
        self.deep = []

    def link(self, pa, pb, since) -> None:
        if self.since is None:
            self.since = np.full((self.size, self.size), np.inf)
        self.since[pa, pb] = since


def _given(frames: Iterator[pd.DataFrame], size: int) -> Iterator[tuple]:
    """(grp, graph, scores of pairs that are next, of the others, known scores of the graph) of each two blocks and graph."""
    key, block, of, known, masks, rep = None, None, None, {}, None, None
    closed = lambda: (of[0], rep, block.score[masks[0]], block.score[masks[1]], known.get(rep))

    def ready(block: _Block, grp: int) -> tuple:
        return block.since == grp + 1, block.since == np.inf

    for pdf in frames:
        for r in pdf.itertuples(index=False):
            here = (r.grp, r.task, r.i, r.j)
            if rep is not None and (here != key or r.rep != rep):
                block.flush()
                yield closed()
                block.score[:], rep = 0, None
            if (r.grp, r.task) != of:
                of, known = (r.grp, r.task), {}
            if r.kind == 0:
                known.setdefault(r.rep, []).append(r.known)
                continue
            if here != key:
                key, block, masks = here, _Block(size, r.i == r.j), None
                block.since = np.zeros((size, size))
            if r.kind == 2:
                block.link(r.pa, r.pb, r.xa)
                continue
            if masks is None:
                masks = ready(block, r.grp)
            rep = r.rep
            block.add(r.u, r.pa, 0, r.xa, r.pb, 0, r.xb)
    if rep is not None:
        block.flush()
        yield closed()


def _given_rows(candidates: DataFrame, graphs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, int]:
    members = settled(numbered(candidates.select(F.explode(F.array("a", "b")).alias("member")).distinct(), [F.col("member")], "n"), "block-members")
    n = members.count()
    size = max(64, min(WIDE, -(-n // 4)))
    pairs = max(1, -(-n // size)) * (-(-n // size) + 1) // 2
    tasks = min(TASKS, pairs)
    task = lambda i, j: F.pmod(F.xxhash64(i, j), F.lit(tasks))
    place = lambda m: members.select(F.col("member").alias(m), F.floor((F.col("n") - 1) / size).alias(f"of_{m}"), ((F.col("n") - 1) % size).cast("int").alias(f"at_{m}"))
    cut = lambda s, c: F.transform(s, lambda v: v[c])
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    lists = settled(graphs.join(place("member"), "member").groupBy("grp", "rep", "item", F.col("of_member").alias("of")).agg(F.first("u").alias("u"), F.sort_array(F.collect_list(F.struct("at_member", "x"))).alias("s")), "block-lists")
    left, right = lists.select("grp", "rep", "item", "u", F.col("of").alias("i"), F.col("s").alias("sa")), lists.select("grp", "rep", "item", F.col("of").alias("j"), F.col("s").alias("sb"))
    # every two blocks get a row of every graph, so that a graph in which none of their pairs scores counts too
    reps = graphs.select("grp", "rep").distinct()
    ends = candidates.select("grp", "next", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(place("a"), "a").join(place("b"), "b")
    since = F.when(F.col("next"), F.col("grp") + 1).otherwise(F.lit(float("inf"))).cast("double").alias("since")
    masks = settled(ends.groupBy("grp", F.col("of_a").alias("i"), F.col("of_b").alias("j"), "at_a").agg(F.collect_list(F.struct("at_b", since)).alias("s")), "block-masks")
    filled = F.transform("s", lambda v: F.col("at_a"))
    head = lambda kind, rep: [F.col("grp").cast("long").alias("grp"), task("i", "j").alias("task"), "i", "j", F.lit(kind).alias("kind"), rep.cast("long").alias("rep")]
    rows = masks.select(*head(2, F.lit(-1)), none("double", "u"), filled.alias("pa"), cut("s", "since").alias("xa"), cut("s", "at_b").alias("pb"), none("array<double>", "xb"), none("array<double>", "known"))
    met = left.join(right, ["grp", "rep", "item"]).where("i <= j").join(masks.select("grp", "i", "j").distinct(), ["grp", "i", "j"], "left_semi")
    rows = rows.unionByName(met.select(*head(3, F.col("rep")), F.col("u").cast("double").alias("u"), cut("sa", "at_member").alias("pa"), cut("sa", "x").alias("xa"), cut("sb", "at_member").alias("pb"), cut("sb", "x").alias("xb"), none("array<double>", "known")))
    nothing = lambda t, c: F.array().cast(t).alias(c)
    empty = masks.select("grp", "i", "j").distinct().join(reps, "grp")
    rows = rows.unionByName(empty.select(*head(3, F.col("rep")), F.lit(0.0).alias("u"), nothing("array<int>", "pa"), nothing("array<double>", "xa"), nothing("array<int>", "pb"), nothing("array<double>", "xb"), none("array<double>", "known")))
    if known is not None:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task")
        rows = rows.unionByName(known.select(F.col("grp").cast("long").alias("grp"), each, F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).alias("kind"), F.col("rep").cast("long").alias("rep"), none("double", "u"), none("array<int>", "pa"), none("array<double>", "xa"), none("array<int>", "pb"), none("array<double>", "xb"), "known"))
    return rows.repartition(2 * tasks, "grp", "task").sortWithinPartitions("grp", "task", "i", "j", "kind", "rep"), size


def given_auc(candidates: DataFrame, graphs: DataFrame, digits: int = 9) -> DataFrame:
    """`grp, rep, auc`: on each graph, how well the given pairs' scores, to so many digits, tell those that are `next`.

    candidates: grp, a, b, next. graphs: grp, rep, item, member, x, u. A pair's score on a graph is the sum of u * x * x over
    common items, zero without any. Only the scores of `next` pairs leave their tasks.
    """
    candidates, graphs = settled(candidates, "given-pairs"), settled(graphs, "given-graphs")

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for grp, rep, fresh, _, _ in _given(frames, size):
            yield pd.DataFrame({"grp": [grp], "rep": [rep], "known": [np.round(fresh, digits)]})

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for grp, rep, fresh, others, known in _given(frames, size):
            others = np.sort(np.round(others, digits))
            marks = np.sort(np.concatenate(known)) if known else np.zeros(0)
            twice = int(np.searchsorted(others, marks, "left").sum() + np.searchsorted(others, marks, "right").sum())
            yield pd.DataFrame({"grp": [grp], "rep": [rep], "n_pos": [len(fresh)], "n_neg": [len(others)], "twice": [float(twice)]})

    rows, size = _given_rows(candidates, graphs)
    known = settled(rows.mapInPandas(first, "grp long, rep long, known array<double>"), "next-scores")
    rows, size = _given_rows(candidates, graphs, known)
    sums = rows.mapInPandas(second, "grp long, rep long, n_pos long, n_neg long, twice double").groupBy("grp", "rep").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.sum("twice").alias("twice"))
    return sums.where("n_pos > 0 AND n_neg > 0").select("grp", "rep", F.round(F.col("twice") / 2 / (F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))
