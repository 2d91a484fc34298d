"""Entity resolution: contractor cells to canonical firms, fuzzy matches, upserts, search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from awardlens.functions import text as fn
from awardlens.operators.settle import settled


def parsed(cells: DataFrame, cell: str = "contractor") -> DataFrame:
    """One row for each firm of each contract cell; `ref` orders the contracts."""
    rows = cells.select("ref", F.explode(fn.contractor_cell(F.col(cell))).alias("f"))
    return rows.select("ref", "f.position", "f.raw", "f.id", "f.revoked", "f.former", "f.display", "f.norm")


def resolved(firms: DataFrame) -> DataFrame:
    """Adds `key`: the id, else the id first seen with the same normal name, else the name; unnamed rows go.

    A firm counts once per contract, at its first place.
    """
    first_id = firms.where("id IS NOT NULL AND norm <> ''").groupBy("norm").agg(F.min_by("id", F.struct("ref", "position")).alias("known"))
    keyed = firms.join(first_id, "norm", "left").withColumn("key", F.coalesce("id", "known", F.when(F.col("norm") != "", F.concat(F.lit("n:"), "norm"))))
    order = Window.partitionBy("ref", "key").orderBy("position")
    return keyed.where("key IS NOT NULL").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "known")


def canonical_names(firms: DataFrame) -> DataFrame:
    """For each key its most frequent display name (of equals the first seen), any revocation, first former name."""
    counted = firms.groupBy("key", "display").agg(F.count("*").alias("n"), F.min(F.struct("ref", "position")).alias("seen"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "seen")
    best = counted.withColumn("k", F.row_number().over(order)).where("k = 1").select("key", F.col("display").alias("name"))
    facts = firms.groupBy("key").agg(F.bool_or("revoked").alias("revoked"), F.min_by("former", F.when(F.col("former").isNotNull(), F.struct("ref", "position"))).alias("former"), F.count_distinct("ref").alias("n_contracts"))
    return best.join(facts, "key")


def _jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity: prefix scale 0.1 up to four characters, above 0.7."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used, hits = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / la + m / lb + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds `similarity` to pairs of names, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(similarity=[round(_jaro_winkler(x, y), 6) for x, y in zip(pdf[a], pdf[b], strict=True)])

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("similarity", DoubleType())]))


def _places(name):
    """The letters of a name, each with its number among equal ones, later ones first."""
    letters = F.split(name, "")
    numbered = F.transform(letters, lambda c, i: F.struct((-F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c))).alias("k"), c.alias("c")))
    return F.transform(F.sort_array(numbered), lambda x: F.concat(x["c"], x["k"].cast("string")))


#: Names of lengths within this factor share a band.
BAND = 1.25


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND) + 1e-9).cast("int")


def _keys(kind: str, least_sum: float, first: Column) -> Column:
    """A name's keys for partners of every band of lengths: the bands, a first letter and a numbered letter.

    With m common letters the Jaro similarity is at most (m / |a| + m / |b| + 1) / 3, so a bound on it is one on
    m / |a| + m / |b|, here `least_sum`: m is least_sum * |a| * |b| / (|a| + |b|) or more, and |b| between
    (least_sum - 1) * |a| and |a| / (least_sum - 1). Of a name's letters in a fixed order all but m - 1 are keys.
    """
    n, own = F.col("n"), _band(F.col("n"))
    bands = F.sequence(_band(F.greatest(F.lit(1), F.ceil((least_sum - 1) * n - 1e-9))), _band(F.floor(n / (least_sum - 1) + 1e-9)))

    def of_band(band: Column) -> Column:
        # no partner of the band is shorter than this, and shorter ones need fewer common letters
        shortest = F.greatest(F.lit(1.0), F.ceil(F.pow(F.lit(BAND), band) - 1e-6), F.ceil((least_sum - 1) * n - 1e-9))
        needed = F.greatest(F.lit(1), F.ceil(least_sum * n * shortest / (n + shortest) - 1e-6).cast("int"))
        letters = F.slice("letters", 1, F.greatest(F.lit(0), n - needed + 1))
        return F.transform(letters, lambda x: F.struct(F.lit(kind).alias("kind"), F.least(own, band).alias("low"), F.greatest(own, band).alias("high"), first.alias("first"), x.alias("letter")))

    return F.flatten(F.transform(bands, of_band))


def fuzzy_matches(names: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs a < b of distinct names whose Jaro-Winkler similarity reaches `least`; no pair is lost.

    At most four equal letters at the start add to a Jaro similarity over 0.7, so names with the same first
    letter need (least - 0.4) / 0.6 or 0.7 of it, others `least`. Either bound makes a prefix join over numbered
    letters (the rarer, later ones first) within bands of lengths; a pair counts only at its first common letter,
    so none is compared twice, and its common letters are counted before it is compared.
    """
    distinct = names.select("name").where("name <> ''").distinct().select("name", F.length("name").alias("n"), _places(F.col("name")).alias("letters"))
    distinct = settled(distinct, "fuzzy-names")
    edge = least - 1e-6  # similarities are rounded to six digits
    alike = 3 * min(edge, max((edge - 0.4) / 0.6, 0.7)) - 1
    other = 3 * edge - 1
    keys = F.concat(_keys("alike", alike, F.substring("name", 1, 1)), _keys("other", other, F.lit("")))
    blocked = distinct.select("name", "n", "letters", F.explode(keys).alias("key"))
    own = _band(F.col("n"))
    x, y = (blocked.where(own == F.col(f"key.{side}")).select(F.col("name").alias(c), F.col("n").alias(f"n_{c}"), F.col("letters").alias(f"l_{c}"), "key") for c, side in (("x", "low"), ("y", "high")))
    same = F.substring("x", 1, 1) == F.substring("y", 1, 1)
    common = F.array_intersect("l_x", "l_y")
    needed = F.when(same, alike).otherwise(other) * F.col("n_x") * F.col("n_y") / (F.col("n_x") + F.col("n_y"))
    once = (F.col("key.low") < F.col("key.high")) | (F.col("x") < F.col("y"))
    met = x.join(y, "key").where(once & (same == (F.col("key.kind") == "alike")))
    likely = met.where((F.get(common, F.lit(0)) == F.col("key.letter")) & (F.size(common) >= needed - 1e-6)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return jaro_winkler(likely.select("a", "b")).where(F.col("similarity") >= least)


def merge_map(matches: DataFrame, auto: float = 0.92) -> DataFrame:
    """name -> canonical for automatic matches: the longer name (of equals the smaller) is canonical."""
    longer = F.when(F.length("a") > F.length("b"), F.col("a")).when(F.length("b") > F.length("a"), F.col("b")).otherwise(F.least("a", "b"))
    pairs = matches.where(F.col("similarity") >= auto).select(longer.alias("canonical"), "a", "b", "similarity")
    named = pairs.select(F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("name"), "canonical", "similarity")
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), "canonical")
    return named.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key where the newer row's columns win, even if null; columns it lacks are kept.

    `new` carries `version`; of several new rows with one key the highest version applies. Rows with a
    null key in `new` are left out.
    """
    order = Window.partitionBy(*key).orderBy(F.desc("version"))
    last = new.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "version")
    columns = [c for c in last.columns if c not in key]
    marked = last.withColumn("_new", F.lit(True))
    joined = old.alias("o").join(marked.alias("n"), key, "full_outer")
    every = [*key, *dict.fromkeys([c for c in old.columns if c not in key] + columns)]

    def pick(c: str):
        if c in key:
            return F.col(c)
        if c in columns and c in old.columns:
            return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return F.col(f"n.{c}" if c in columns else f"o.{c}").alias(c)

    return joined.select(*(pick(c) for c in every))


def upsert_edges(edges: DataFrame, nodes: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Edges with both ends known, one for each pair: of several the one of the highest version."""
    known = nodes.select("id")
    both = edges.join(known.withColumnRenamed("id", src), src, "left_semi").join(known.withColumnRenamed("id", dst), dst, "left_semi")
    order = Window.partitionBy(src, dst).orderBy(F.desc("version"))
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null or blank key go."""
    named = rows.where(" AND ".join(f"{k} IS NOT NULL AND CAST({k} AS STRING) <> ''" for k in key))
    return named.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def search_exact(entities: DataFrame, text: str) -> DataFrame:
    """Entities whose label or aliases contain every word of a query, ranked.

    Rank 0: equal to the label, 1: its beginning, 2: inside it, 3: in an alias; ties by value, id.
    """
    want = fn.search_form(F.lit(text))
    label, hay = fn.search_form(F.col("label")), fn.search_form(F.concat_ws(" ", "label", F.array_join("aliases", " ")))
    rank = F.when(label == want, 0).when(label.startswith(want), 1).when(label.contains(want), 2).otherwise(3)
    rows = entities.where(F.forall(F.split(want, " "), lambda t: hay.contains(t)))
    return rows.select("id", "label", rank.alias("rank"), "value").orderBy("rank", F.desc("value"), "id")


def search_similar(entities: DataFrame, text: str, limit: int = 40) -> DataFrame:
    """Entities with a word within each query word's slack of edits (0, 1 or 2 by its length)."""
    want = F.split(fn.search_form(F.lit(text)), " ")
    words = F.split(fn.search_form(F.col("label")), " ")

    def near(t):
        slack = F.when(F.length(t) <= 3, 0).when(F.length(t) <= 6, 1).otherwise(2)
        gap = lambda w: F.when(w.startswith(t), 0).otherwise(F.levenshtein(w, t))
        best = F.array_min(F.transform(words, gap))
        return F.when(best <= slack, best)

    costs = F.transform(want, near)
    rows = entities.withColumn("rank", F.aggregate(costs, F.lit(0), lambda a, x: a + x)).where("rank IS NOT NULL")
    return rows.select("id", "label", "rank", "value").orderBy("rank", F.desc("value"), "id").limit(limit)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """The k nearest vectors by cosine of each query, among all vectors.

    vectors, queries: id, embedding. The queries are cut in blocks of about `block`, sent to every
    task one block after the other; each partition keeps its own best k before the best are joined.
    """
    import numpy as np

    block = block or QUERY_BLOCK
    spark = vectors.sparkSession
    asked = settled(queries.select("id", "embedding"), "query-vectors")
    blocks = max(1, -(-asked.count() // block))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    best = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toPandas()
        if not len(part):
            continue
        q = spark.sparkContext.broadcast((part["id"].to_numpy(), unit(np.stack(part["embedding"].to_numpy()).astype(float))))

        def run(frames: Iterator[pd.DataFrame], q=q) -> Iterator[pd.DataFrame]:
            names, m = q.value
            for pdf in frames:
                own, rows = pdf["id"].to_numpy(), unit(np.stack(pdf["embedding"].to_numpy()).astype(float))
                for top in range(0, len(names), QUERY_STRIP):  # so many queries' similarities are held at a time
                    found, some = [], names[top : top + QUERY_STRIP]
                    s = np.round(rows @ m[top : top + QUERY_STRIP].T, 6)
                    for j, name in enumerate(some):
                        keep = np.lexsort((own, -s[:, j]))[: k + 1]
                        found.append(keep[own[keep] != name][:k])
                    keep, j = np.concatenate(found), np.repeat(np.arange(len(some)), [len(f) for f in found])
                    yield pd.DataFrame({"query": some[j], "id": own[keep], "similarity": s[keep, j]})

        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        found = vectors.select("id", "embedding").mapInPandas(run, "query long, id long, similarity double")
        found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
        if blocks > 1:  # the block's results are written, so that its vectors leave memory
            found = settled(found, "nearest")
            q.destroy()
        best = found if best is None else best.unionByName(found)
    return best if best is not None else spark.createDataFrame([], "query long, id long, similarity double, k int")


#: Query vectors that a task holds at a time.
QUERY_BLOCK = 4096
#: Of these, queries that a batch of vectors is compared with at a time.
QUERY_STRIP = 128
