"""Source divergence audit by wide term vectors.

Within each language, sources are compared by smoothed term shares. Tasks count the terms of whole
texts and add them up before anything is sent; each term is then pivoted into an array with one
place for each source of its language. Higher-order functions turn such an array into shares and
into the contributions of source pairs, which map-side aggregation sums.

A term's share in a group with `count` of its N kept occurrences is
p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), V being the language's kept terms; all arithmetic is
on whole numbers (38 digits). Two sources without a term still differ by their shares of an absent
term, which is the same for all such terms; so only pairs with a term are emitted, as their excess
over that, and V times the shares' difference is added once.

Defined results: null text, language and source are ''; every row counts as a document of its own,
repeated or not; a source without kept terms is compared like any other; a language with one source
has no pairs, one without kept terms has pairs of value 0; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardlens.llm.text import BROADCAST_ROWS, byte_column, stored, tidy

#: Letters A to Z in either case and everything beyond ASCII, over UTF-8 bytes.
TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")
LOWER = bytes(c + 32 if 0x41 <= c < 0x5B else c for c in range(256))
SCALE = 1_000_000_000
SMOOTH = 5
#: Entries that a task holds before it sends them on (about 200 bytes each), and bytes of a text that are cut into terms at a time.
HELD, PIECE = 1_000_000, 1 << 20
#: A term's occurrences and documents in one number: the documents in the lower 32 bits. Both fit, since it is sent after READ bytes.
DOCS, READ = 1 << 32, 1 << 30

COUNTED = "lang string, source string, term string, n long, n_docs long"


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of about PIECE bytes at a time; pieces end where a term ends."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        run = TERM.match(text, cut)
        cut = run.end() if run else cut
        yield TERM.findall(text[at:cut].translate(LOWER))
        at = cut
    yield TERM.findall((text[at:] if at else text).translate(LOWER))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), summed as far as a task holds them."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    entries = read = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            n = np.fromiter(terms.values(), dtype=np.int64, count=len(terms))
            columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.string()), pa.array(n // DOCS), pa.array(n % DOCS)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), byte_column(batch, "text"), strict=True):
            group = held.setdefault((lang or "", source or ""), {})
            entries -= len(group)
            own: Counter[bytes] = Counter()
            for terms in text_terms(text):
                own.update(terms)
            for t, n in own.items():
                group[t] = group.get(t, 0) + n * DOCS + 1
            entries, read = entries + len(group), read + len(text)
            if entries > HELD or read > READ:
                yield from sent()
                entries = read = 0
    yield from sent()


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kinds)), exactly."""
    above = (count + SMOOTH).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTH * kinds).cast("decimal(28,0)")
    return F.call_function("div", above, below) + 1


def term_vectors(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """lang, term, total, counts (source, n): every term of at least `min_docs` documents of its language.

    One shuffle by language and term serves both sums.
    """
    counted = docs.select("lang", "source", "text").mapInArrow(tidy(count_terms), COUNTED).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    gathered = by_source.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return gathered.where(F.col("n_docs") >= min_docs).drop("n_docs")


def groups_of(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, sources (sorted), totals and absent (the share of an absent term) by source, kinds, total."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = vectors.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    kinds = vectors.groupBy("lang").agg(F.count("*").alias("kinds"))
    each = named.join(totals, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gathered = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    langs = gathered.join(kinds, "lang", "left").withColumn("kinds", F.coalesce("kinds", F.lit(0)))
    out = langs.select("lang", F.transform("g", lambda x: x["source"]).alias("sources"), F.transform("g", lambda x: x["n"]).alias("totals"), "kinds", F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"))
    absent = F.when(F.col("kinds") > 0, F.transform("totals", lambda n: share(F.lit(0), n, F.col("kinds"))))
    return out.withColumn("absent", F.coalesce(absent, F.transform("totals", lambda n: F.lit(0).cast("long"))))


def wide(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, counts and shares by place of the source, overall (the language's share), absent."""
    joined = vectors.join(groups.withColumnRenamed("total", "whole"), "lang")
    found = F.map_from_entries("counts")
    counts = joined.select("lang", "term", "absent", "kinds", "totals", "total", "whole", F.transform("sources", lambda s: F.coalesce(F.element_at(found, s), F.lit(0))).alias("counts"))
    shares = F.transform("counts", lambda n, i: share(n, F.get("totals", i), F.col("kinds")))
    return counts.select("lang", "term", "counts", "absent", shares.alias("shares"), share(F.col("total"), F.col("whole"), F.col("kinds")).alias("overall"))


def pair_excess(terms: DataFrame) -> DataFrame:
    """lang, i, j (places, i < j), excess: what the terms that either source has add beyond absent ones."""
    present = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.get("counts", i) > 0)
    rows = terms.select("lang", "counts", "shares", "absent", F.explode(present).alias("i"))
    others = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda j: (j != F.col("i")) & ((F.get("counts", j) == 0) | (j > F.col("i"))))
    gap = lambda v, j: F.abs(F.get(v, F.col("i")) - F.get(v, j))
    emitted = F.transform(others, lambda j: F.struct(F.least("i", j).alias("i"), F.greatest(F.col("i"), j).alias("j"), (gap("shares", j) - gap("absent", j)).alias("x")))
    return rows.select("lang", F.explode(emitted).alias("e")).groupBy("lang", "e.i", "e.j").agg(F.sum("e.x").alias("excess"))


def report(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances to other sources and the terms that mark a source.

    Part `pair` has every other source of the language, part `term` the first `top` terms whose share
    in the source is above the language's. Ranks go by value from the largest, then by item.
    """
    vectors = stored(term_vectors(docs, min_docs), "term-vectors")
    groups = stored(groups_of(docs, vectors), "term-groups")
    small = groups.agg(F.sum(F.size("sources"))).first()[0] or 0
    terms = wide(vectors, F.broadcast(groups) if small <= BROADCAST_ROWS else groups)

    rows = groups.select("lang", "sources", "absent", "kinds", F.posexplode("sources").alias("i", "source"))
    later = F.filter(F.sequence(F.lit(0), F.size("sources") - 1), lambda j: j > F.col("i"))
    named = lambda j: F.struct(j.alias("j"), F.get("sources", j).alias("other"), (F.abs(F.get("absent", F.col("i")) - F.get("absent", j)) * F.col("kinds")).alias("base"))
    pairs = rows.select("lang", "i", "source", F.explode(F.transform(later, named)).alias("o")).select("lang", "i", "source", "o.*")
    valued = pairs.join(pair_excess(terms), ["lang", "i", "j"], "left").withColumn("value", F.col("base") + F.coalesce("excess", F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    far = valued.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    marks = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: (F.get("counts", i) > 0) & (F.get("shares", i) > F.col("overall")))
    placed = terms.select("lang", "term", F.explode(F.transform(marks, lambda i: F.struct(i.alias("i"), (F.get("shares", i) - F.col("overall")).alias("value")))).alias("m"))
    order = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    best = placed.select("lang", "m.i", F.col("term").alias("item"), "m.value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = rows.select("lang", "i", "source")
    marked = best.join(F.broadcast(names) if small <= BROADCAST_ROWS else names, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return far.withColumn("rank", F.row_number().over(by_value)).unionByName(marked)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT lang, source, CAST(count(*) AS HUGEINT) AS docs FROM d GROUP BY 1, 2),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
filled AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(n) AS n FROM filled GROUP BY 1, 2),
gn AS (SELECT lang, source, sum(n) AS total FROM filled GROUP BY 1, 2),
wn AS (SELECT lang, sum(n) AS total FROM whole GROUP BY 1),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (CAST({SCALE} AS HUGEINT) * (f.n + 5)) // (gn.total + 5 * v.v) AS p FROM filled f JOIN gn USING (lang, source) JOIN v USING (lang)),
q AS (SELECT w.lang, w.term, 1 + (CAST({SCALE} AS HUGEINT) * (w.n + 5)) // (wn.total + 5 * v.v) AS q FROM whole w JOIN wn USING (lang) JOIN v USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3),
marked AS (SELECT p.lang, p.source, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM far UNION ALL SELECT lang, source, 'term', item, value FROM marked),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
