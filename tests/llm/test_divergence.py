import collections
import re

from pyspark.sql import functions as F

from awardlens.llm import divergence as d

SCHEMA = "lang string, source string, text string"


def brute(rows, least, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    terms = [re.findall(r"[A-Za-z\x80-\U0010ffff]+", t.translate(low)) for _, _, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, count = collections.Counter(), collections.defaultdict(collections.Counter)
        for (lg, source, _), ts in zip(rows, terms, strict=True):
            if lg == lang:
                docs.update(set(ts))
                count[source].update(ts)
        kept = [t for t in docs if docs[t] >= least]
        whole = collections.Counter()
        for c in count.values():
            whole.update({t: c[t] for t in kept})

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s, own in shares.items():
            far = sorted((-sum(abs(own[t] - x[t]) for t in kept), o.encode()) for o, x in shares.items() if o != s)
            near = sorted((-(own[t] - q[t]), t.encode()) for t in kept if count[s][t] and own[t] > q[t])[:top]
            out |= {(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", far), ("term", near)) for i, (v, item) in enumerate(found)}
    return out


def rows_of():
    words = ["the", "THE", "straße", "STRASSE", "Éa", "éa", "x1y", "don't", "日本", "zebra", "foo"]
    rows = [(("en", "de", None)[i % 3], ("s1", "s2", "s3", "s4")[i % 4] if i % 5 else "hot", " ".join(words[(i * j) % len(words)] for j in range(i % 9))) for i in range(200)]
    return rows + [("en", "empty", None), ("en", None, "the the the"), ("fr", "alone", "le"), ("it", "a", "uno"), ("it", "b", "due"), ("en", "s1", "the"), ("en", "s1", "the")]


def test_report_matches_brute_force(spark):
    rows = rows_of()
    for least, top in ((3, 2), (1, 50), (30, 50), (10_000, 50)):
        got = [tuple(r) for r in d.report(spark.createDataFrame(rows, SCHEMA).repartition(5), least, top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least, top), (least, top)


def test_small_pieces_held_entries_and_joins_change_nothing(spark, monkeypatch):
    rows = rows_of()
    text = "Abc déf 12 " * 50 + "x" * 300
    words = [t.lower().encode() for t in re.findall(r"[^\W\d_]+", text)]
    assert sum(d.text_terms(text.encode()), []) == words
    monkeypatch.setattr(d, "PIECE", 7)
    assert sum(d.text_terms(text.encode()), []) == words
    monkeypatch.setattr(d, "HELD", 20)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in d.report(spark.createDataFrame(rows, SCHEMA), 3).collect()} == brute(rows, 3)


def test_very_large_counts_stay_exact(spark):
    big = 10**15
    [row] = spark.range(1).select(d.share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).collect()
    assert row.p == 1 + 10**9 * (big + 5) // (3 * big + 35)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    assert d.report(df.limit(0)).count() == 0
    more = df.withColumns({"Term": F.lit(1), "a.b": F.lit(2), "VALUE": F.lit(3), "n": F.lit(4)})
    assert {tuple(r) for r in d.report(more, 3).collect()} == brute(rows_of(), 3)
