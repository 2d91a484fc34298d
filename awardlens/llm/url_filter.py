"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join with the list.

A listed entry is a host and a path: it fits the host and all its subdomains where the path starts
with the entry's path. Entries of rank 0 are of canonical URLs: for them a URL loses user and
port, dots at the host's end and percent escapes, and an empty path is `/`; entries of a higher rank
are compared with host and path as they stand. A URL's keys are its host's suffixes with its path's
beginnings, of the numbers of labels and the lengths that the list has, so their number is bounded
by the list however long a URL is. All keys probe the Bloom filter; the few that pass are joined with
the list by equality, which removes the false positives. The longest entry that fits decides. The
list is any table of `host, path, verdict`.

A block of the Bloom filter is one 64-byte line: a key's hash picks the line and `PROBES` bits in
it. Its size follows the list up to `max_bits`; beyond, more keys pass and the join still decides.

Defined results: a null URL, or one without `://`, has an empty host and path and no rule;
repeated rows and ids keep a row each; an empty table or list gives a result all the same; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.llm.text import stored, word_hashes

LINE_BITS = 512
PROBES = 6
#: Parts that the rows of a frequent URL are joined in, and rows from which on a URL may be one; at most one in 100,000 rows is.
SALTS, FREQUENT = 64, 1000

#: The rules that the URL query fixes, then sites listed as unwanted: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UNWANTED = ("spam-farm", "casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track")


def split_url(url):
    """Columns for the lower-cased host and the path of a URL column."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), path


def _hash(keys: list[str]) -> np.ndarray:
    if not keys:
        return np.zeros(0, dtype=np.uint64)
    raw = [k.encode("utf-8", "surrogatepass").translate(None, b" \t\n\x0b\x0c\r") or b"-" for k in keys]
    return word_hashes(raw)[0]


def _bits(h: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and word masks of each hash: (n,), (n, 8)."""
    line = (h >> np.uint64(32)) % np.uint64(lines)
    masks = np.zeros((len(h), 8), dtype=np.uint64)
    step = ((h >> np.uint64(9)) & np.uint64(0x1FF)) | np.uint64(1)
    at = h & np.uint64(0x1FF)
    rows = np.arange(len(h))
    for _ in range(PROBES):
        masks[rows, (at >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (at & np.uint64(63))
        at = (at + step) & np.uint64(0x1FF)
    return line.astype(np.int64), masks


def bloom_lines(listed: DataFrame, bits_per_key: int = 16, max_bits: int = 1 << 28) -> np.ndarray:
    """The filter of a list's `key` column, (lines, 8) 64-bit words; at most max_bits in all.

    Tasks set bits for their keys and send touched lines; lines are or-ed by number in Spark.
    """
    n = listed.count()
    lines = int(max(1, min(n * bits_per_key, max_bits) // LINE_BITS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            line, masks = _bits(_hash(pdf["key"].tolist()), lines)
            order = np.argsort(line, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(line[order]) != 0]) if len(line) else []
            joined = np.bitwise_or.reduceat(masks[order], cut, axis=0) if len(line) else masks
            yield pd.DataFrame({"line": line[order][cut] if len(line) else line} | {f"w{k}": joined[:, k].view(np.int64) for k in range(8)})

    schema = "line long, " + ", ".join(f"w{k} long" for k in range(8))
    merged = listed.select("key").mapInPandas(run, schema).groupBy("line").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)))
    out = np.zeros((lines, 8), dtype=np.uint64)
    for r in merged.toLocalIterator():  # at most max_bits / LINE_BITS lines
        out[r["line"]] = np.array([r[f"w{k}"] for k in range(8)], dtype=np.int64).view(np.uint64)
    return out


def listed(entries: DataFrame, rank: int = 0) -> DataFrame:
    """A list frame from any table of `host, path, verdict`. Entries of a higher rank come first; nulls are left out."""
    e = entries.select(F.lower("host").alias("host"), "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    key = F.concat(F.lit(f"{rank}|"), "host", F.lit("|"), "path")
    rule = F.concat("host", "path")
    return e.select(key.alias("key"), rule.alias("rule"), "verdict", F.lit(rank).alias("rank"), F.length(rule).alias("length"), F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("path_length"))


def listed_urls(spark, entries, rank: int = 0) -> DataFrame:
    """The same from (host, path, verdict) tuples."""
    return listed(spark.createDataFrame(list(entries), "host string, path string, verdict string"), rank)


def default_list(spark) -> DataFrame:
    """The fixed rules and the unwanted sites under each registry of the example domain."""
    sites = [(f"{name}.example.{top}", "/", "block") for name in UNWANTED for top in ("com", "net", "org")]
    return listed_urls(spark, RULES, 1).unionByName(listed_urls(spark, sites))


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host without user, port and final dots; path without percent escapes, never empty."""
    return re.sub(r":\d*\Z", "", host.rpartition("@")[2]).rstrip("."), unquote(path) or "/"


def keys_of(host: str, path: str, shapes: dict[int, tuple[list[int], list[int]]]) -> Iterator[str]:
    """The keys that a URL could have in a list of such numbers of labels and path lengths by rank."""
    for rank, (labels, lengths) in shapes.items():
        h, p = (host, path) if rank else canonical(host, path)
        parts = h.rsplit(".", max(labels, default=0))
        for n in labels:
            if n <= len(parts):
                suffix = ".".join(parts[len(parts) - n :])
                yield from (f"{rank}|{suffix}|{p[:k]}" for k in lengths if k <= len(p))


def judged(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """`page_id, host, path, rule, rank, verdict` for every row.

    The entry of the highest rank that fits decides, of several the longest.
    """
    spark = pages.sparkSession
    shapes: dict[int, tuple[list[int], list[int]]] = {}
    for r in listed.groupBy("rank").agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("path_length")).alias("lengths")).collect():  # a row per rank
        shapes[r["rank"]] = (list(r.labels), list(r.lengths))
    filter_lines = spark.sparkContext.broadcast(bloom_lines(listed))

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = filter_lines.value
        for pdf in frames:
            keys, owner = [], []
            for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"], strict=True)):
                own = list(keys_of(host, path, shapes))
                keys += own
                owner += [i] * len(own)
            line, masks = _bits(_hash(keys), len(held))
            passed = np.flatnonzero(((held[line] & masks) == masks).all(1))
            at = [owner[k] for k in passed]
            yield pd.DataFrame({"host": pdf["host"].to_numpy()[at], "path": pdf["path"].to_numpy()[at], "key": [keys[k] for k in passed]})

    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    counts = stored(parsed.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")), "url-counts")
    limit = max(FREQUENT, (counts.agg(F.sum("n")).first()[0] or 0) // 100_000)
    frequent = F.broadcast(counts.where(F.col("n") > limit).select("host", "path", F.lit(SALTS).alias("salts")))  # at most 100,000 rows
    possible = counts.select("host", "path").mapInPandas(candidates, "host string, path string, key string")
    hits = possible.join(listed.select("key", "rule", "verdict", "rank", "length"), "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("rank", "length", "rule", "verdict")).alias("b"))
    # only a URL of very many pages is joined in parts
    best = best.join(frequent, ["host", "path"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    salt = F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
    salted = parsed.join(frequent, ["host", "path"], "left").withColumn("salt", salt).drop("salts")
    named = salted.join(best, ["host", "path", "salt"], "left")
    return named.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.col("b.rank").alias("rank"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, r, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
sites AS (
  SELECT s || '.example.' || t AS h FROM (VALUES ('spam-farm'), ('casino-win'), ('free-bets'), ('cheap-pills'), ('adult-x'), ('ads-track')) AS a(s), (VALUES ('com'), ('net'), ('org')) AS b(t)),
hit AS (
  SELECT page_id, max_by(h || r, length(h || r)) AS rule, max_by(v, length(h || r)) AS v
  FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r) GROUP BY page_id),
bad AS (
  SELECT DISTINCT page_id
  FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS c FROM q) JOIN sites ON c = h OR ends_with(c, '.' || h))
SELECT q.page_id, q.host, q.path, hit.rule, coalesce(hit.v, CASE WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN hit ON q.page_id = hit.page_id LEFT JOIN bad ON q.page_id = bad.page_id
"""
