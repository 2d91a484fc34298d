import collections
import re

from pyspark.sql import functions as F

from awardlens.llm import quality_rules as q

LONG = " ".join(f"word{i}" for i in range(20000))
TEXTS = [None, "", " \t ", "a b c a b c a b", "a a a a", "x\ny\nx\n\n \nx", "Q*# é|ñ", "α β γ α β γ", LONG, " ".join(f"w{i}" for i in range(60)), "SHOUT " * 55]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in q.with_verdict(q.ledger(df)).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(TEXTS[r.doc_id]), r.doc_id
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation_use_the_bits_alone(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    book = q.ledger(df)
    rows = book.collect()
    table = {r.rule: (r.n_failed, r.n_only, r.n_rows) for r in q.ablation(book, "v2").collect()}
    for i, rule in enumerate(q.RULES):
        assert table[rule.name] == (sum(r.failed_bits >> i & 1 for r in rows), sum(r.failed_bits == 1 << i for r in rows), len(rows))
    assert q.ledger(df.limit(0)).count() == 0
    assert q.mask_of("base") == 3


def test_clashing_columns_are_replaced_and_others_carried(spark):
    df = spark.createDataFrame([(1, "a b c a b c a b", 5)], "doc_id long, text string, N_SYMBOLS int").withColumns({"a.b": F.lit(1), "_COUNTED": F.lit(2), "Failed_Bits": F.lit(3), "KEPT": F.lit(4), "x`y": F.lit(6), "_by_line": F.lit(7), "__counted_lines": F.lit(8)})
    out = q.with_verdict(q.ledger(df))
    assert out.columns == ["doc_id", "text", "a.b", "_COUNTED", "x`y", "_by_line", "__counted_lines", *q.MEASURES, "failed_bits", "base_failed", "kept"]
    [r] = out.collect()
    assert (r.n_words, r.n_repeat_words, r["a.b"], r._COUNTED, r["x`y"], r._by_line) == (8, 8, 1, 2, 6, 7)
