"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are cut into blocks. Block i (from 0) of a source with weight w may not be
placed before slot floor(i / w) and not after slot ceil((i + 1) / w) - 1; earliest deadline first
among the released blocks then keeps every source within one block of w times the slots so
far, at every slot, while all sources last. When a source has no blocks left, the weights of
the others are scaled up and their windows begin anew, so the same holds for each phase.

Blocks have the same rows at every size of the table. Weights are whole numbers over a bounded
sum, so the earliest-deadline order of a phase repeats after one period: every source places as
many blocks in it as its weight says, and all their windows end in it. The driver schedules one period
of each phase (or less, where the phase is shorter) and a block's slot is found by its number: the
phase by the blocks its source has before it, the period by division, the slot in the period by a
join. So the plan grows with sources and the sum of weights, not with the table. Rows find
their block by numbers that need no large group in one task: rows of a source are spread over
buckets by a hash of their id, numbered inside a bucket, and offset by the bucket totals of
their source.

Nothing is dropped: all rows of all sources are placed. Defined results: a null source is a
source of its own; repeated rows and ids keep a place each, ties in any order of equal rows; null
ids come first in their bucket; an empty table gives an empty result. `mixed` returns the input's
columns and five of its own, which replace input columns of the same names; `in_mixed_order`
returns the input's columns alone, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardlens.llm.text import BROADCAST_ROWS, row_of

BUCKETS = 64
BUCKET_ROWS = 500_000
#: The weights' sum, to rounding; every source weighs one at least, so many sources can raise it.
PERIOD = 10_000


def target_weights(counts: dict[str, int], power: float = 0.5) -> dict[str, Fraction]:
    """Weights in proportion to a power of each source's rows, over a sum of about PERIOD."""
    return rounded({s: n**power for s, n in counts.items()})


def rounded(weights: dict, period: int = PERIOD) -> dict:
    """The nearest weights over a sum of about `period`, one at least, as exact fractions that sum to 1."""
    total = sum(weights.values())
    whole = {s: max(1, round(period * w / total)) for s, w in weights.items()}
    return {s: Fraction(v, sum(whole.values())) for s, v in whole.items()}


@dataclass
class Phase:
    """The slots until a source ends: sources' weights, blocks placed before, and one period's order."""

    start: int
    slots: int
    period: int
    weights: dict
    before: dict
    order: list


def _order(weights: list[int], ends: list[int]) -> list[int]:
    """Numbers of the sources in earliest-deadline order over one period, or until one has placed `ends` blocks."""
    period = sum(weights)
    waiting, ready = [(0, k) for k in range(len(weights))], []
    placed, order = [0] * len(weights), []
    while len(order) < period:
        while waiting and waiting[0][0] <= len(order):
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(placed[k] + 1) * period // weights[k]), k))
        _, k = heapq.heappop(ready)
        order.append(k)
        placed[k] += 1
        if placed[k] == ends[k]:
            break
        heapq.heappush(waiting, (placed[k] * period // weights[k], k))
    return order


def phases(blocks: dict, weights: dict) -> list[Phase]:
    """The phases of a schedule of `blocks` by exact weights."""
    plan, slot = [], 0
    done = dict.fromkeys(blocks, 0)
    live = [s for s in sorted(blocks) if blocks[s]]
    while live:
        exact = [Fraction(weights[s]) for s in live]
        common = math.lcm(*(w.denominator for w in exact))
        whole = [int(w * common) for w in exact]
        whole = [w // math.gcd(*whole) for w in whole]
        period, left = sum(whole), [blocks[s] - done[s] for s in live]
        cycles = min(-(-n // w) - 1 for n, w in zip(left, whole, strict=True))  # whole periods before a source ends
        order = _order(whole, left)
        placed, last = [0] * len(live), 0
        for last, k in enumerate(order):
            placed[k] += 1
            if cycles * whole[k] + placed[k] == left[k]:
                break
        slots = cycles * period + last + 1
        plan.append(Phase(slot, slots, period, dict(zip(live, whole, strict=True)), {s: done[s] for s in live}, [live[k] for k in order]))
        for k, s in enumerate(live):
            done[s] += cycles * whole[k] + placed[k]
        slot += slots
        live = [s for s in live if done[s] < blocks[s]]
    return plan


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """(source, block number, slot, phase) of every block, one block in each slot."""
    plan = []
    for number, phase in enumerate(phases(blocks, weights)):
        done = dict(phase.before)
        for i in range(phase.slots):
            s = phase.order[i % phase.period]
            plan.append((s, done[s], phase.start + i, number))
            done[s] += 1
    return plan


def mixed(docs: DataFrame, power: float = 0.5, block_rows: int = 16, max_blocks: int | None = None, weights: dict | None = None, source: str = "source") -> DataFrame:
    """Input columns and `source_rank, block, slot, position, phase` for every row.

    position numbers all rows in mixed order without gaps. Where `max_blocks` is asked for, blocks
    grow so that there are at most as many and one more for each source.
    """
    added = ("source_rank", "block", "slot", "position", "phase")
    kept = docs.select(*("`" + c.replace("`", "``") + "`" for c in docs.columns if c.lower() not in added))
    placed = _placed(_named(docs, row_of(kept), source), power, block_rows, max_blocks, weights)
    return placed.select("row.*", *added)


def _named(docs: DataFrame, row: Column, source: str) -> DataFrame:
    """`row, s, h, id`: a row's source as text and a hash that spreads rows, of one id by their texts."""
    spread = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    return docs.select(row.alias("row"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("_s"), F.xxhash64(*spread).alias("_h"), F.col("doc_id").alias("_id"))


def _placed(named: DataFrame, power: float = 0.5, block_rows: int = 16, max_blocks: int | None = None, weights: dict | None = None) -> DataFrame:
    """`row` of every named row with its source rank, block, slot, position and phase."""
    spark = named.sparkSession
    counts = {r["_s"]: r.n for r in named.groupBy("_s").agg(F.count("*").alias("n")).collect()}  # a row per source
    whole = sum(counts.values())
    buckets = max(BUCKETS, whole // BUCKET_ROWS)
    keyed = named.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("_s", "_b").agg(F.count("*").alias("n")).select("_s", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    size = max(block_rows, -(-whole // max_blocks)) if max_blocks else block_rows
    share = rounded({("s" + str(k) if k is not None else ""): v for k, v in weights.items()}) if weights else target_weights(counts, power)
    spans, places = _tables({s: -(-n // size) for s, n in counts.items()}, counts, share, size)
    spans_of = spark.createDataFrame(spans, "_s string, _spans array<struct<first: long, phase: int, weight: long, period: long, start: long, at: long>>")
    place = spark.createDataFrame(places, "_s string, phase int, _j long, _in long")
    if len(counts) <= BROADCAST_ROWS:  # beyond (very many sources), joins
        spans_of = F.broadcast(spans_of)
    if len(places) <= BROADCAST_ROWS:
        place = F.broadcast(place)
    order = Window.partitionBy("_s", "_b").orderBy("_h", "_id")
    ranked = keyed.withColumn("_r", F.row_number().over(order) - 1)
    ranked = ranked.join(base, ["_s", "_b"]).withColumn("source_rank", F.col("_o") + F.col("_r"))
    ranked = ranked.withColumn("block", F.floor(F.col("source_rank") / size).cast("long"))
    in_phase = ranked.join(spans_of, "_s").withColumn("_x", F.element_at(F.filter("_spans", lambda x: x["first"] <= F.col("block")), -1)).drop("_spans")
    of_phase = F.col("block") - F.col("_x.first")
    numbered = in_phase.withColumn("phase", F.col("_x.phase")).withColumn("_j", F.pmod(of_phase, F.col("_x.weight")))
    found = numbered.join(place, ["_s", "phase", "_j"])
    slot = F.expr("(block - _x.first) div _x.weight * _x.period + _in")
    position = (F.col("_x.at") + F.col("_slot") * size + F.col("source_rank") - F.col("block") * size).alias("position")
    return found.withColumn("_slot", slot).select("row", "source_rank", "block", (F.col("_x.start") + F.col("_slot")).alias("slot"), position, "phase")


def _tables(blocks: dict, counts: dict, weights: dict, size: int) -> tuple[list, list]:
    """Rows of each source's phases (first block, weight, period, first slot and position) and of their periods' slots.

    A phase ends with the one block in it that may be short, its source's last.
    """
    spans, places, at = {s: [] for s in blocks}, [], 0
    for number, phase in enumerate(phases(blocks, weights)):
        seen = dict.fromkeys(phase.weights, 0)
        for i, s in enumerate(phase.order):
            places.append((s, number, seen[s], i))
            seen[s] += 1
        for s, w in phase.weights.items():
            if seen[s]:
                spans[s].append((phase.before[s], number, w, phase.period, phase.start, at))
        last = phase.order[(phase.slots - 1) % phase.period]
        at += phase.slots * size - (blocks[last] * size - counts[last])
    return list(spans.items()), places


def in_mixed_order(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The input rows and columns, laid out in mixed order over the partitions."""
    placed = _placed(_named(docs, row_of(docs), source), **options).select("row", "position")
    return placed.repartitionByRange(F.col("position")).sortWithinPartitions("position").select("row.*")
