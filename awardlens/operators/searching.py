"""Entity search over a written inverted index: exact and similar tiers for many questions at once.

Entities have `id, label, aliases array<struct<text, kind>>, value`. The index has four tables, each
sorted by its key over all files, so that a range of keys reads the files that hold it:

* `entities`: the search forms of label and aliases,
* `postings`: word -> entities,
* `beginnings`: the first three characters of every word's every end -> words. A piece
  of a word is the beginning of one of its ends, so inner pieces and beginnings of words are found alike,
* `segments`: the three thirds of every word, with its length -> words. Two edits leave one third whole, which
  then stands in the other word at most two places off.

The last two grow with distinct words, not with entities. A question takes its candidates from the word
that has the fewest postings and is then checked against each candidate's own text, so the answers are
those of a scan. Entities beyond what a question needs are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from awardlens.functions import text as fn
from awardlens.operators.settle import settled

#: Results of a question, exact ones from which on none are looked for that are only similar, characters of a key.
MOST, ENOUGH, KEY = 40, 8, 3


@dataclass(frozen=True)
class Index:
    """The written tables."""

    entities: DataFrame
    postings: DataFrame
    beginnings: DataFrame
    segments: DataFrame


def slack(word: Column) -> Column:
    """Edits that a question's word may be off by."""
    return F.when(F.length(word) <= 3, 0).when(F.length(word) <= 6, 1).otherwise(2)


def left_out(word: Column, most: int = 2) -> Column:
    """A word with up to `most` characters left out, each form once."""
    forms = F.array(word)
    for _ in range(most):
        once = F.transform(forms, lambda f: F.transform(F.sequence(F.lit(1), F.greatest(F.length(f), F.lit(1))), lambda i: F.concat(F.substring(f, F.lit(1), i - 1), F.substring(f, i + 1, F.length(f)))))
        forms = F.array_union(forms, F.flatten(once))
    return forms


def _third(word: Column, length: Column, i: Column, place: Column | None = None) -> tuple[Column, Column, Column]:
    """Start (from 0) and length of the third `i` of words of a length, and its key for what stands in a word at `place` (its start, if none)."""
    width = F.floor(length / 3)
    start, wide = i * width, F.when(i == 2, length - 2 * width).otherwise(width)
    return start, wide, F.concat_ws(":", length, i, F.substring(word, (start if place is None else place) + 1, wide))


def _sorted(df: DataFrame, key: str, purpose: str) -> DataFrame:
    return settled(df.repartitionByRange(key).sortWithinPartitions(key), purpose)


def build(entities: DataFrame) -> Index:
    """The index of entities(id, label, aliases, value); blank aliases and repeated ones are left out."""
    named = F.filter(F.transform("aliases", lambda a: F.struct(a["text"].alias("text"), a["kind"].alias("kind"), fn.search_form(a["text"]).alias("norm"))), lambda a: a["norm"] != "")
    first = F.filter(named, lambda a, i: ~F.exists(F.slice(named, 1, i), lambda b: b["norm"] == a["norm"]))
    rows = entities.select("id", "label", "value", fn.search_form(F.coalesce("label", F.lit(""))).alias("norm"), F.coalesce(first, F.array().cast("array<struct<text:string,kind:string,norm:string>>")).alias("aliases"))
    rows = rows.withColumn("hay", F.concat_ws(" ", "norm", F.array_join(F.transform("aliases", lambda a: a["norm"]), " ")))
    rows = _sorted(settled(rows, "search-forms"), "id", "search-entities")
    postings = _sorted(rows.select(F.explode(F.array_distinct(F.split(F.trim("hay"), " +"))).alias("word"), "id").where("word <> ''"), "word", "search-postings")
    words = settled(postings.groupBy("word").agg(F.count("*").alias("n")), "search-words")
    ends = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).select("word", "n", (F.col("i") - 1).alias("at"), F.expr("substring(word, i)").alias("end"))
    keys = ends.select(F.substring("end", 1, KEY).alias("key"), "end", "at", "word", "n")
    # a word within the slack of a token has three letters at least
    thirds = words.where(F.length("word") >= 3).select("word", "n", F.explode(F.array(*(_third(F.col("word"), F.length("word"), F.lit(i))[2] for i in range(3)))).alias("third"))
    return Index(rows, postings, _sorted(keys, "key", "search-beginnings"), _sorted(thirds, "third", "search-segments"))


def _tokens(questions: DataFrame) -> DataFrame:
    """q, want (search form), tokens of the questions that have any."""
    forms = questions.select("q", fn.search_form("text").alias("want")).where("want <> ''")
    return settled(forms.withColumn("tokens", F.split("want", " ")), "search-questions")


def _begun(index: Index, tokens: DataFrame) -> DataFrame:
    """q, token, at, word, n: words one of whose ends begins with the token."""
    asked = tokens.select("q", F.explode(F.array_distinct("tokens")).alias("token"))
    found = []
    for k in range(1, KEY + 1):  # tokens shorter than a key meet its beginning
        some = asked.where(F.length("token") == k if k < KEY else F.length("token") >= k).withColumn("begin", F.substring("token", 1, k))
        found.append(some.join(index.beginnings, F.col("begin") == F.substring("key", 1, k)).where(F.startswith("end", "token")).select("q", "token", "at", "word", "n"))
    return reduce(DataFrame.unionByName, found)


def _near(index: Index, asked: DataFrame) -> DataFrame:
    """q, token, word, n: words at most the token's slack away; asked: q, token."""
    off = slack(F.col("token"))
    sizes = asked.where(off > 0).select("q", "token", F.explode(F.sequence(F.length("token") - off, F.length("token") + off)).alias("size"))
    sizes = sizes.select("q", "token", "size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    start, wide, _ = _third(F.col("token"), F.col("size"), F.col("i"))
    places = sizes.select("*", F.greatest(start - off, F.lit(0)).alias("low"), F.least(start + off, F.length("token") - wide).alias("high")).where("low <= high").select("q", "token", "size", "i", F.explode(F.sequence("low", "high")).alias("place"))
    keys = places.select("q", "token", _third(F.col("token"), F.col("size"), F.col("i"), F.col("place"))[2].alias("third")).distinct()
    return keys.join(index.segments, "third").where(F.levenshtein("token", "word") <= off).select("q", "token", "word", "n")


def _candidates(index: Index, tokens: DataFrame, words: DataFrame) -> DataFrame:
    """q, want, tokens and the entities that have a word for the token with the fewest postings; words: q, token, word, n.

    A question with a token that no word stands for has none.
    """
    words = settled(words.distinct(), "search-found-words")
    sums = words.groupBy("q", "token").agg(F.sum("n").alias("n"))
    rarest = sums.groupBy("q").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count("*").alias("met"))
    whole = tokens.join(rarest, "q").where(F.col("met") == F.size(F.array_distinct("tokens"))).select("q", "want", "tokens", "token")
    ids = whole.join(words.select("q", "token", "word"), ["q", "token"]).join(index.postings, "word").select("q", "want", "tokens", "id").distinct()
    return ids.join(index.entities, "id")


def _distance(token: Column, words: Column) -> Column:
    """Edits from a token to the nearest of some words, null if none is near enough; 0 to a word that it begins."""
    gap = F.transform(words, lambda w: F.when(F.startswith(w, token), 0).otherwise(F.levenshtein(w, token)))
    best = F.array_min(gap)
    return F.when(best <= slack(token), best)


def _reason(hit) -> tuple[Column, Column]:
    """Kind and text of the alias that explains a match, null where the label matches by itself; hit(text form)."""
    found = F.get(F.filter("aliases", lambda a: hit(a["norm"])), F.lit(0))
    alias = F.coalesce(found, F.get("aliases", F.lit(0)))
    return F.when(~hit(F.col("norm")), alias["kind"]), F.when(~hit(F.col("norm")), alias["text"])


def search(index: Index, questions: DataFrame) -> DataFrame:
    """`q, place, id, label, similar, rank, reason_kind, reason`: up to MOST entities for each question(q, text).

    Exact: every word of the question is part of the entity's text. Rank 0 is the label itself, 1 its
    beginning, 2 a part of it, 3 an alias. Where fewer than ENOUGH are exact, entities follow that have a word
    near each word of the question, by their edits. Ties go by value, then by id.
    """
    tokens = _tokens(questions)
    holds = lambda form: F.forall("tokens", lambda t: F.contains(form, t))
    begun = settled(_begun(index, tokens), "search-begun")
    met = _candidates(index, tokens, begun.select("q", "token", "word", "n")).where(holds(F.col("hay")))
    rank = F.when(F.col("norm") == F.col("want"), 0).when(F.startswith("norm", "want"), 1).when(F.contains("norm", "want"), 2).otherwise(3)
    kind, text = _reason(holds)
    exact = settled(met.select("q", "id", "label", "value", F.lit(False).alias("similar"), rank.alias("rank"), kind.alias("reason_kind"), text.alias("reason")), "search-exact")

    full = exact.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH)
    thin = settled(tokens.join(full, "q", "left_anti"), "search-thin")
    off = _near(index, thin.select("q", F.explode(F.array_distinct("tokens")).alias("token")))
    starts = begun.where("at = 0").join(thin.select("q"), "q", "left_semi").select("q", "token", "word", "n")
    near = lambda form: F.transform("tokens", lambda t: _distance(t, F.split(form, " ")))
    close = lambda form: F.forall(near(form), lambda d: d.isNotNull())
    like = _candidates(index, thin, starts.unionByName(off)).where(close(F.trim("hay"))).join(exact.select("q", "id"), ["q", "id"], "left_anti")
    kind, text = _reason(close)
    edits = F.aggregate(near(F.trim("hay")), F.lit(0), lambda a, x: a + x)
    similar = like.select("q", "id", "label", "value", F.lit(True).alias("similar"), edits.alias("rank"), kind.alias("reason_kind"), text.alias("reason"))

    order = Window.partitionBy("q").orderBy("similar", "rank", F.desc("value"), "id")
    placed = exact.unionByName(similar).withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST)
    return placed.select("q", "place", "id", "label", "similar", "rank", "reason_kind", "reason")


def fulltext(index: Index, prefix: str, kinds: tuple[str, ...] | None = None, limit: int = 20) -> DataFrame:
    """`id, label, score`: the first `limit` entities with words that begin with a prefix, then those of some kinds (the id's part before ':').

    The score sums ln(1 + (N - n + 0.5) / (n + 0.5)) over the words found, n being a word's entities and N all.
    As in a full-text index that knows no kinds, the limit comes before the kinds.
    """
    term = fn.search_form(F.lit(prefix))
    hits = index.postings.where(F.startswith("word", term) & (term != ""))
    total = index.entities.agg(F.count("*").alias("all"))  # one row
    n = hits.groupBy("word").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    score = F.sum(F.log(1 + (F.col("all") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    best = hits.join(n, "word").groupBy("id").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    found = best.join(index.entities.select("id", "label"), "id").select("id", "label", "score")
    return found if kinds is None else found.where(F.substring_index("id", ":", 1).isin(list(kinds)))
