"""License scan: an exact set-similarity join of text blocks with license templates.

A place of a template is a stretch of as many words as the template has (a whole text, if shorter)
that holds at least `threshold` of its distinct words, and its distinguishing words (`needs`) in
their order. Words that tell a sibling license (`bars`) may not stand in the stretch, nor right beside
a distinguishing word at its edge; words of `around` nowhere in the block. So a notice of one license
never counts for another whose name alone differs, and a notice beside it keeps its own label.

Blocks find the candidates. A block is a window of words, whatever the lines: for each template the
window has the least power of two that is twice the template's words or more, and windows overlap by
half, so every stretch of the template's length lies in a block.

The join orders words by their count in the whole corpus, rarest first. If block and template
share `need` words, then they share a word among the template's first `size - need + 1` words,
and that word lies in the block's own first `size - need + 1` template words (prefix filter); the
block must have `need` template words (length filter), and what follows the shared word on both
sides must still allow `need` (positional filter). Only blocks with a prefix word leave the scan;
Spark joins them with the prefix table, checks the overlap, and each block's best place is verified
word by word. A text's base places travel once, not with each of its blocks.

Words that no template has can never count towards an overlap, so they are left out of both
sides. Templates are a parameter: the prefix table and the word order have as many rows as the
templates have words, whatever the corpus.

Defined results: a null text counts as empty; repeated rows and ids keep a row each; null ids
stay null; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.llm.text import byte_column, tidy, word_pieces

#: Fixed phrases of the base scan and their labels.
PHRASES = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

_LONG_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_LONG_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_LONG_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_LONG_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."""
_LONG_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
_LONG_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {} for more details."""
_NOT_GPL = "affero lesser library"
_NOT_BY = "sa nc nd sharealike noncommercial noderivatives noderivs"


def _gnu(name: str, version: str) -> str:
    return _GNU_NOTICE.format(name, version, name)


#: Label, notice (public wording of common licenses), words that it needs in this order, words that bar it in its
#: place, and words that bar it in its block.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0", "apache", ""),
    ("apache", _LONG_APACHE, "apache", ""),
    ("mit", "Released under the MIT License", "mit", ""),
    ("mit", "Licensed under the MIT License", "mit", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "granted charge obtaining", ""),
    ("mit", _LONG_MIT, "granted charge obtaining", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution forms", ""),
    ("bsd", _LONG_BSD, "redistribution forms", ""),
    ("isc", _LONG_ISC, "fee granted", "charge"),
    ("zlib", _LONG_ZLIB, "alter freely", ""),
    ("unlicense", _LONG_UNLICENSE, "unencumbered", ""),
    ("gpl", "licensed under the GNU General Public License", "gnu general", _NOT_GPL),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general", _NOT_GPL),
    ("gpl", _gnu("General Public License", "3"), "gnu general", _NOT_GPL),
    ("lgpl", "licensed under the GNU Lesser General Public License", "gnu lesser", "affero"),
    ("lgpl", _gnu("Lesser General Public License", "3"), "gnu lesser", "affero"),
    ("agpl", "licensed under the GNU Affero General Public License", "gnu affero", "lesser"),
    ("agpl", _gnu("Affero General Public License", "3"), "gnu affero", "lesser"),
    ("mpl", "subject to the terms of the Mozilla Public License", "mozilla", ""),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "mpl mozilla", ""),
    ("cc-by", "Licensed under CC BY 4.0", "cc by", _NOT_BY),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution", _NOT_BY),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa", "nc nd"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons sharealike", "noncommercial noderivatives"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc", "sa nd"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons noncommercial", "sharealike noderivatives"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd", "sa nc"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa", "nd"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative commons noncommercial sharealike", ""),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd", "sa"),
    ("cc0", "CC0 1.0 Universal public domain dedication", "cc0", ""),
    ("public-domain", "released into the public domain", "public domain", "", "unencumbered"),
    ("reserved", "All rights reserved", "all rights reserved", ""),
)

_KEEP = bytes(c if chr(c).isdigit() or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


@dataclass(frozen=True)
class Template:
    """A notice: its distinct words, its blocks' words, and the words that it needs or that bar it."""

    number: int
    label: str
    words: frozenset[bytes]
    window: int
    length: int
    needs: tuple[bytes, ...]
    bars: frozenset[bytes]
    around: frozenset[bytes]

    def need(self, threshold: float) -> int:
        return math.ceil(threshold * len(self.words) - 1e-9)


@dataclass(frozen=True)
class Ranked:
    """What verifying a place takes, with words as ranks."""

    length: int
    need: int
    words: frozenset[int]
    needs: tuple[int, ...]
    bars: frozenset[int]
    around: frozenset[int]


def words_of(text: bytes) -> list[bytes]:
    """Runs of lower-cased letters, digits and bytes of other characters."""
    return text.translate(_KEEP).split()


def known_templates(templates=TEMPLATES) -> list[Template]:
    out = []
    for i, (label, text, needs, bars, *around) in enumerate(templates):
        words = words_of(text.encode())
        barred = frozenset(words_of(bars.encode())), frozenset(words_of(" ".join(around).encode()))
        out.append(Template(i, label, frozenset(words), 1 << max(1, (2 * len(words) - 1).bit_length()), len(words), tuple(words_of(needs.encode())), *barred))
    return out


def starts(n: int, window: int) -> range:
    """First words of the blocks of n words: half a window apart; the last one reaches the end."""
    return range(0, max(1, n - window // 2), window // 2)


def word_order(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[bytes, int]:
    """Rank of every template word by its count over all texts, rarest first, ties by the word."""
    vocabulary = frozenset().union(*(t.words | {*t.needs} | t.bars | t.around for t in known_templates(templates)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in byte_column(batch, "t"):
                for piece in word_pieces(t):
                    total.update(filter(vocabulary.__contains__, words_of(piece)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col(text).alias("t")).mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {bytes(r.word): r.n for r in counts.collect()}  # as many rows as the templates have words
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}


def read(text: bytes, order: dict[bytes, int]) -> tuple[int, list[tuple[int, str]], list[int], list[int]]:
    """A text's words, base places, and the places and ranks of its template words."""
    n, places, at, ranks = 0, [], [], []
    longest = max(len(p.split()) for p in PHRASES) - 1
    tail: list[bytes] = []
    for piece in word_pieces(text):
        words = words_of(piece)
        for i, w in enumerate(words):
            if w in order:
                at.append(n + i)
                ranks.append(order[w])
        line = b" " + b" ".join([*tail, *words]) + b" "
        for phrase, label in PHRASES.items():
            size, seen, word, found = len(phrase.split()), 0, n - len(tail), line.find(b" " + phrase + b" ")
            while found >= 0:
                word, seen = word + line.count(b" ", seen, found), found
                if word + size > n:  # else it was found in the piece before
                    places.append((word, label))
                found = line.find(b" " + phrase + b" ", found + 1)
        n += len(words)
        tail = [*tail, *words][-longest:]
    return n, places, at, ranks


def candidate_blocks(n: int, at: list[int], ranks: list[int], window: int, wanted: frozenset[int], least: int) -> Iterator[dict]:
    """Blocks with `least` template words and a wanted one in their prefix: once for each of those."""
    half = window // 2
    count = len(starts(n, window))
    near = {b for p, r in zip(at, ranks, strict=True) if r in wanted for b in (p // half - 1, p // half) if 0 <= b < count}
    for b in sorted(near):
        low, high = bisect_left(at, b * half), bisect_left(at, b * half + window)
        own = sorted(set(ranks[low:high]))
        low, high = max(0, low - 1), high + 1  # with the word before and after, if a template has it
        where = [p - b * half for p in at[low:high]]
        for k, r in enumerate(own[: max(0, len(own) - least + 1)]):
            if r in wanted:
                yield {"rank": r, "at": k, "window": window, "first_word": b * half, "ranks": own, "places": where, "place_ranks": ranks[low:high]}


def best_place(n: int, window: int, places: list[int], ranks: list[int], t: Ranked) -> int:
    """The most distinct words of a template in a place of it that lies in a block of `n` words at most, 0 for none.

    places: where the block's template words stand, from its first word; those beside the block are told by them.
    """
    size = min(n, window)
    inside = [(p, r) for p, r in zip(places, ranks, strict=True) if 0 <= p < size]
    if t.around & {r for _, r in inside}:
        return 0
    by_place = dict(zip(places, ranks, strict=True))
    length, best = min(t.length, size), 0
    held: Counter = Counter()
    distinct = bars = head = tail = 0
    for start in range(size - length + 1):
        while head < len(inside) and inside[head][0] < start + length:
            r = inside[head][1]
            held[r] += 1
            distinct += held[r] == 1 and r in t.words
            bars += r in t.bars
            head += 1
        while inside[tail : tail + 1] and inside[tail][0] < start:
            r = inside[tail][1]
            held[r] -= 1
            distinct -= held[r] == 0 and r in t.words
            bars -= r in t.bars
            tail += 1
        if distinct < max(t.need, best + 1) or bars:
            continue
        beside = [(start, start - 1), (start + length - 1, start + length)]
        if any(by_place.get(edge) in t.needs and by_place.get(out) in t.bars for edge, out in beside):
            continue
        wanted = iter(t.needs)
        missing = next(wanted, None)
        for _, r in inside[tail:head]:
            if r == missing:
                missing = next(wanted, None)
        if missing is None:
            best = distinct
    return best


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """One row for each input row: its words, base places, and the matching blocks.

    `doc_id, n_words, places array<struct<word, label>>, matches array<struct<label, template, first_word,
    containment>>`. matches holds every block that contains `threshold` of a template.
    """
    spark = docs.sparkSession
    known = known_templates(templates)
    order = word_order(docs, templates, text)
    prefix = []
    for t in known:
        ranked, need = sorted(order[x] for x in t.words), t.need(threshold)
        prefix += [(r, t.window, t.number, t.label, at, len(ranked), need, ranked) for at, r in enumerate(ranked[: len(ranked) - need + 1])]
    as_ranks = lambda ws: frozenset(order[x] for x in ws)
    rules = {t.number: Ranked(t.length, t.need(threshold), as_ranks(t.words), tuple(order[x] for x in t.needs), as_ranks(t.bars), as_ranks(t.around)) for t in known}
    wanted = {w: frozenset(p[0] for p in prefix if p[1] == w) for w in {t.window for t in known}}
    least = {w: min(t.need(threshold) for t in known if t.window == w) for w in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, n_words, places, found = [], [], [], []
            for t in byte_column(batch, "t"):
                n, base, at, ranks = read(t, order)
                rows.append(row)
                n_words.append(n)
                places.append([{"word": a, "label": b} for a, b in base])
                found.append([c for w in wanted for c in candidate_blocks(n, at, ranks, w, wanted[w], least[w])] if at else [])
                row += 1
            arrays = [pa.array(rows, pa.int64()), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(places, places_type), pa.array(found, found_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_words", "places", "found"])

    places_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("rank", pa.int32()), ("at", pa.int32()), ("window", pa.int32()), ("first_word", pa.int64()), ("ranks", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("place_ranks", pa.list_(pa.int32()))]))
    schema = "row long, doc_id long, n_words long, places array<struct<word: long, label: string>>, found array<struct<rank: int, at: int, window: int, first_word: long, ranks: array<int>, places: array<int>, place_ranks: array<int>>>"
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidy(run), schema)
    table = F.broadcast(spark.createDataFrame(prefix, "rank int, t_window int, template int, label string, t_at int, t_size int, need int, t_ranks array<int>"))
    each = scanned.select("row", "doc_id", "n_words", "places", F.posexplode_outer("found").alias("k", "c"))
    each = each.withColumn("places", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("places")))
    size = F.size("c.ranks")
    allowed = (size >= F.col("need")) & (F.col("c.at") <= size - F.col("need"))  # length and prefix
    left = F.least(F.col("t_size") - F.col("t_at"), size - F.col("c.at"))
    joined = each.join(table, (F.col("c.rank") == F.col("rank")) & (F.col("c.window") == F.col("t_window")) & allowed & (left >= F.col("need")), "left")
    likely = F.size(F.array_intersect("c.ranks", "t_ranks")) >= F.col("need")
    first_shared = F.get(F.array_intersect("c.ranks", "t_ranks"), F.lit(0)) == F.col("rank")  # a block is verified once for a template
    kept = lambda c: F.when(likely & first_shared, F.col(c))
    blocks = joined.select("row", "doc_id", "n_words", "places", kept("template").alias("template"), kept("label").alias("label"), kept("t_size").alias("t_size"), kept("c.first_word").alias("first_word"), kept("c.window").alias("window"), kept("c.places").alias("at"), kept("c.place_ranks").alias("ranks"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            columns = (batch.column(c).to_pylist() for c in ("template", "n_words", "first_word", "window", "at", "ranks"))
            for template, n, first, window, at, ranks in zip(*columns, strict=True):
                best.append(None if template is None else best_place(n - first, window, at, ranks, rules[template]))
            kept = [batch.column(c) for c in ("row", "doc_id", "n_words", "places", "template", "label", "t_size", "first_word")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.int32())], names=["row", "doc_id", "n_words", "places", "template", "label", "t_size", "first_word", "best"])

    verified = blocks.mapInArrow(tidy(verify), "row long, doc_id long, n_words long, places array<struct<word: long, label: string>>, template int, label string, t_size int, first_word long, best int")
    match = F.when(F.col("best") > 0, F.struct("label", "template", "first_word", (F.col("best") / F.col("t_size")).alias("containment")))
    return (
        verified.select("row", "doc_id", "n_words", "places", match.alias("m"))
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("places", ignorenulls=True).alias("places"), F.sort_array(F.collect_set("m")).alias("matches"))
        .drop("row")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and a score for each scanned row."""
    base = F.transform("places", lambda p: p["label"])
    word = F.transform("places", lambda p: p["word"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def oracle(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for the digest of a scan of `documents`: all stretches of the blocks that hold enough of a template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = lambda w: "[{}]::VARCHAR[]".format(", ".join(f"'{x.decode()}'" for x in w))
    phrases = ", ".join("([{}], '{}')".format(", ".join(f"'{w.decode()}'" for w in p.split()), label) for p, label in PHRASES.items())
    rows = (f"({t.number}, '{t.label}', {t.window}, {t.length}, {listed(sorted(t.words))}, {listed(t.needs)}, ' {' (.* )?'.join(x.decode() for x in t.needs)} ', {listed(sorted(t.bars))}, {listed(sorted(t.around))}, {t.need(threshold)})" for t in known_templates(templates))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}), known(number, label, size, length, t, needs, ordered, bars, around, need) AS (VALUES {", ".join(rows)}),
places AS (SELECT row, label, pos FROM (SELECT row, w, unnest(range(len(w))) AS pos FROM d), phrases WHERE w[pos + 1:pos + len(p)] = p),
sizes AS (SELECT DISTINCT size FROM known),
blocks AS (SELECT row, w, size, pos, w[pos + 1:pos + size] AS b
           FROM (SELECT row, size, w, unnest(range(0, greatest(1, len(w) - size // 2), size // 2)) AS pos FROM d, sizes WHERE len(w) > 0)),
likely AS (SELECT row, w, pos, len(b) AS n, known.* FROM blocks JOIN known USING (size) WHERE list_has_all(b, needs) AND NOT list_has_any(b, around) AND len(list_intersect(list_distinct(b), t)) >= need),
stretches AS (SELECT *, w[place + 1:place + least(length, n)] AS s FROM (SELECT *, unnest(range(pos, pos + n - least(length, n) + 1)) AS place FROM likely)),
found AS (SELECT row, label, len(list_intersect(list_distinct(s), t)) / len(t) AS share FROM stretches
          WHERE len(list_intersect(list_distinct(s), t)) >= need AND NOT list_has_any(s, bars) AND regexp_matches(' ' || array_to_string(s, ' ') || ' ', ordered)
            AND NOT (list_contains(needs, s[1]) AND place > 0 AND list_contains(bars, w[place])) AND NOT (list_contains(needs, s[-1]) AND len(w) > place + len(s) AND list_contains(bars, w[place + len(s) + 1]))),
a AS (SELECT row, count(*) AS n, min(pos) AS x, max(pos) AS y, list(DISTINCT label) AS ls FROM places GROUP BY 1),
m AS (SELECT row, max(share) AS share, list(DISTINCT label) AS ls FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(x AS BIGINT) AS first_word, CAST(y AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(a.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a.ls, []), coalesce(m.ls, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN a ON d.row = a.row LEFT JOIN m ON d.row = m.row
"""
