"""Prefix trie of conversations by Patricia construction.

Conversations are sequences of turns. Every distinct beginning of a sequence is a node, but only
branches, ends and leaves are built: sequences are sorted over all tasks, and one pass over each
sorted part keeps a stack of the points on the current path. A point is created where neighbours
part or where a sequence ends; edges between points stay compressed, and all aggregates are summed
on points. When a point is closed, the unary nodes of its edge are written out from it: they share
its members, and what they save is the point's own plus a suffix sum of words along the edge.

A path at the border of two parts may go on in the next one. The nodes on a part's first and last
path are therefore written as partial sums under the digest of their turns; neighbours are compared
by one record for each part, and the partial sums of a node are added up in the order of parts. All
sums are exact whatever the number of parts; a group of equal sequences may span many of them.

Turns are told apart by the first 128 bits of SHA-256 over role and text.

Defined results: turns go by `turn`, nulls first, ties by role and then by the digest of the text; a
null role or text is empty; repeated rows are turns of their own; rows without a conversation id
belong to no conversation; an empty table gives no nodes (not even a root); columns other than the
four are left out, whatever their names. The digests of one conversation's turns (about 24 bytes
each) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardlens.llm.text import BROADCAST_ROWS, stored, tidy

#: Bytes of a turn's digest, rows of an output batch, ids in one record, and copies of a border node in a join.
TURN, ROWS, CHUNK_IDS, SALTS = 16, 20_000, 1 << 16, 64

SEQUENCES = "conv_id long, key binary, words array<int>"
#: kind: 0 a finished node, 1 a node whose parent is on a border path, 2 a partial sum of a border path, 3 a part's borders.
NODES = (
    "kind int, part int, seq int, depth long, digest binary, parent_digest binary, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, first_key binary, first_words array<int>"
)
NO_ENDS = hashlib.sha256(b"").hexdigest().encode()
_FIELDS = ("kind", "part", "seq", "depth", "digest", "parent_digest", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "first_key", "first_words")
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.binary(), pa.binary(), pa.list_(pa.int32()))
PARENT = _FIELDS.index("parent_conv_id")


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (digest as hex, words) in the order of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    held = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_heads(convs: DataFrame, base: Column, length: Column, longest: int) -> DataFrame:
    """Each conversation with its first `length` turns taken from conversation `base` (none where that is absent).

    Only the first `longest` turns of conversations that may be a base travel to those that take them.
    """
    wanted = convs.withColumn("base", base).withColumn("taken", length)
    heads = convs.withColumn("base", base).where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, longest).alias("head"))
    joined = wanted.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, F.col("taken"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("taken") + 1, F.size("turns") + 1)).alias("turns"))


def keyed(convs: DataFrame) -> DataFrame:
    """SEQUENCES: digests end to end, which sort like the sequences, and the words of each turn."""
    return convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while high - low > 1:  # a prefix of `low` turns is equal, one of `high` is not
        mid = (low + high) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid
    return low


def path_digests(key: bytes) -> list[bytes]:
    """A digest for each depth of a key's path, the root first."""
    out = [b"root"]
    for at in range(0, len(key), TURN):
        out.append(hashlib.blake2b(out[-1] + key[at : at + TURN], digest_size=TURN).digest())
    return out


class Point:
    """A branch, end or leaf with what its subtree holds so far."""

    __slots__ = ("depth", "least", "members", "children", "leaves", "below", "ends", "waiting")

    def __init__(self, depth: int):
        self.depth, self.least, self.members, self.children, self.leaves, self.below = depth, None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[list] = []

    def leaf_count(self) -> int:
        return self.leaves or 1


def joined_ids(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


class Rows:
    """Output rows, sent on as Arrow batches."""

    def __init__(self):
        self.rows: list[list] = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_FIELDS))


class Builder:
    """One pass over a sorted part: the stack holds the points of the last row's path."""

    def __init__(self, part: int):
        self.part, self.out = part, Rows()
        self.stack: list[Point] = [Point(0)]
        self.key: bytes | None = None
        self.cum: list[int] = [0]  # words up to each depth of the last row
        self.first: tuple[bytes, list[int]] = (b"", [])
        self.first_digests: list[bytes] = []
        self.border = 0  # down to this depth, which always has a point, the last row's path is the first row's

    def row(self, key: bytes, conv_id: int, words: list[int]) -> None:
        depth = len(key) // TURN
        if self.key is None:
            self.first, self.first_digests, self.border = (key, words), path_digests(key), depth
        elif key != self.key:
            shared = common_turns(self.key, key)
            self.close_to(shared)
            self.border = min(self.border, shared)
        if depth > self.stack[-1].depth:
            self.stack.append(Point(depth))
        end = self.stack[-1]
        end.members += 1
        end.least = conv_id if end.least is None else min(end.least, conv_id)
        end.ends.append(conv_id)
        if key != self.key:
            self.key, self.cum = key, list(accumulate(words, initial=0))

    def close_to(self, depth: int) -> None:
        """Close all points below `depth`; afterwards there is a point at `depth`."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth))
            if point.depth <= self.border:
                self.write_border(point, self.stack[-1].depth, self.first_digests)
            else:
                self.write_edge(point, self.stack[-1])
            self.add_up(point, self.stack[-1])

    def add_up(self, point: Point, above: Point) -> None:
        """What a closed point and its edge add to the point above."""
        above.members += point.members
        above.least = point.least if above.least is None else min(above.least, point.least)
        above.children += 1
        above.leaves += point.leaf_count()
        above.below += self.saved_from(point, above.depth + 1)

    def saved_from(self, point: Point, depth: int) -> int:
        """What the subtree of the node at `depth` on a point's edge saves: a suffix sum of words along the edge."""
        return point.below + (point.members - 1) * (self.cum[point.depth] - (self.cum[depth - 1] if depth else 0))

    def write_edge(self, point: Point, above: Point) -> None:
        """The finished nodes of a point and its edge; the topmost waits for its parent's smallest member."""
        n, least, leaves = point.members, point.least, point.leaf_count()
        for row in point.waiting:
            row[PARENT] = least
        self.out.rows.extend(point.waiting)
        for d in range(point.depth, above.depth, -1):
            own = d == point.depth
            ends = hashlib.sha256(joined_ids(point.ends)).hexdigest().encode() if own and point.ends else NO_ENDS
            row = [0, self.part, 0, d, None, None, least, least, n, point.children if own else 1, leaves, self.saved_from(point, d), ends, None, None]
            if d > above.depth + 1:
                self.out.rows.append(row)
            elif above.depth <= self.border:
                self.out.rows.append(under_border(row, self.first_digests[above.depth]))
            else:
                above.waiting.append(row)

    def write_border(self, point: Point, above: int, digests: list[bytes]) -> None:
        """Partial sums of a point on the first or last path and of its edge down from depth `above`."""
        self.out.rows.extend(under_border(row, digests[point.depth]) for row in point.waiting)
        n, leaves = point.members, point.leaf_count()
        for d in range(point.depth, above, -1):
            parent = digests[d - 1] if d else None
            children = point.children if d == point.depth else 1
            self.out.rows.append([2, self.part, 0, d, digests[d], parent, point.least, None, n, children, leaves, self.saved_from(point, d), None, None, None])
        for k, at in enumerate(range(0, len(point.ends), CHUNK_IDS)):
            self.out.rows.append([2, self.part, k + 1, point.depth, digests[point.depth], None, None, None, 0, 0, 0, 0, joined_ids(point.ends[at : at + CHUNK_IDS]), None, None])

    def finish(self) -> None:
        if self.key is None:
            return
        digests = path_digests(self.key)
        while self.stack:
            point = self.stack.pop()
            self.write_border(point, self.stack[-1].depth if self.stack else -1, digests)
            if self.stack:
                self.add_up(point, self.stack[-1])
        self.out.rows.append([3, self.part, 0, 0, self.key, None, None, None, 0, 0, 0, 0, None, *self.first])


def under_border(row: list, digest: bytes) -> list:
    """A finished node whose parent is found later by its digest."""
    row[0], row[PARENT - 2], row[PARENT] = 1, digest, None
    return row


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NODES of one sorted part."""
    builder = Builder(TaskContext.get().partitionId())
    for batch in batches:
        for key, conv_id, words in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words")), strict=True):
            builder.row(key, conv_id, words)
            if len(builder.out.rows) >= ROWS:
                yield builder.out.batch()
    builder.finish()
    yield builder.out.batch()


def mend_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the partial sums of the nodes that two neighbouring parts share miss or count twice."""
    out = Rows()
    for batch in batches:
        for part, before, key, words in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "first_key", "first_words")), strict=True):
            shared = common_turns(before, key)
            cum, extended = list(accumulate(words, initial=0)), len(before) == shared * TURN
            for d, digest in enumerate(path_digests(key[: shared * TURN])):
                saved = cum[shared] - (cum[d - 1] if d else 0)
                out.rows.append([2, part, 0, d, digest, None, None, None, 0, -(d < shared), -extended, saved, None, None, None])
            if len(out.rows) >= ROWS:
                yield out.batch()
    yield out.batch()


def merge_partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of border paths from their partial sums, which come in order of depth, digest, part and seq."""
    out, node, ends = Rows(), None, None

    def finished() -> None:
        node[-3] = ends.hexdigest().encode()
        out.rows.append(node)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _FIELDS), strict=True):
            if node is None or (row[3], row[4]) != (node[3], node[4]):
                if node is not None:
                    finished()
                node, ends, begun = [1, 0, 0, row[3], row[4], None, None, None, 0, 0, 0, 0, None, None, None], hashlib.sha256(), False
            node[5] = node[5] or row[5]
            if row[6] is not None:
                node[6] = row[6] if node[6] is None else min(node[6], row[6])
            for i in range(8, 12):
                node[i] += row[i]
            if row[12]:
                ends.update(b"," + row[12] if begun else row[12])
                begun = True
        if len(out.rows) >= ROWS:
            yield out.batch()
    if node is not None:
        finished()
    yield out.batch()


def nodes(ordered: DataFrame) -> DataFrame:
    """All nodes of the trie of SEQUENCES: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = ordered.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    raw = stored(parts.mapInArrow(tidy(build), NODES), "trie-nodes")
    borders = raw.where("kind = 3").select("part", F.col("digest").alias("last_key"), "first_key", "first_words")
    # one row for each part, so one task may order them
    seams = borders.select("part", F.lag("last_key").over(Window.orderBy("part")).alias("before"), "first_key", "first_words").where(F.col("before").isNotNull())
    partial = raw.where("kind = 2").unionByName(seams.mapInArrow(tidy(mend_seams), NODES))
    grouped = partial.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "part", "seq")
    merged = stored(grouped.mapInArrow(tidy(merge_partials), NODES), "trie-borders")
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent_digest"), F.col("conv_id").alias("found"))
    hanging = raw.where("kind = 1").unionByName(merged).drop("parent_conv_id")
    if merged.count() <= BROADCAST_ROWS:
        placed = hanging.join(F.broadcast(parents), ["depth", "parent_digest"], "left")
    else:  # a border node may have very many children: they are dealt over SALTS copies of it
        salted = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = hanging.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, ["depth", "parent_digest", "salt"], "left")
    both = raw.where("kind = 0").unionByName(placed.withColumnRenamed("found", "parent_conv_id").select(*raw.columns))
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").cast("string").alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of a conversations table."""
    return nodes(keyed(sequences(conversations)))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie after every conversation c has taken its first crc32(c) % 4 turns from conversation c - c % 20."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string")) % 4).cast("int")
    return nodes(keyed(with_heads(sequences(conversations), c - c % 20, h, 3)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS s,
         list(len(regexp_extract_all(text, '[^ 	-]+')) ORDER BY turn NULLS FIRST, role, text) AS w
  FROM t GROUP BY 1),
h AS (
  SELECT *, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [CAST(k AS BIGINT) for k in range(8)]), lambda b, y: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295) % 4 AS INT) AS h
  FROM own),
r AS (
  SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w
  FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, d, s[1:d] AS k, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, len(s) = d AS ended FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (
  SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM p GROUP BY k),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
up AS (
  SELECT k[1:e] AS k, sum((n_convs - 1) * w) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS e FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN up ON up.k = f.k LEFT JOIN n o ON f.depth > 0 AND o.k = f.k[1:f.depth - 1]
"""
