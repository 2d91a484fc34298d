"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once. The ledger keeps the measurements and one bit per failed rule;
policies are masks over those bits, so changing a policy or measuring what one rule adds
never reads a text again. Repeated windows are told by 64-bit hashes: two different windows of one
text count as equal with a chance of about windows^2 / 2^65.

Defined results: a null text counts as empty (it has no words and fails `few_words`); repeated
rows and repeated ids keep one ledger row each; an empty table gives an empty ledger; columns
of the input named like a column of the ledger, in any case of letters, are replaced in its output,
others are carried whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardlens.llm.text import quoted

SEPARATOR = r"[\x20\x09-\x0D]+"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A named predicate over measurements; its place in RULES is its bit."""

    name: str
    failed: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("long_words", "word_chars > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "shouting"),
    "v2": tuple(r.name for r in RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def mask_of(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, by version or by rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in set(names))


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words lying in a window of three words that occurs twice or more in the text.

    Windows are compared by 64-bit hash. Only texts with a repeated window sort their windows.
    """

    def windows(w):
        last = F.size(w) - WINDOW
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def covered(g):
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s):
            same = lambda x, k: x["h"] == F.get(s, k)["h"]
            kept = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            places = F.sort_array(F.transform(kept, lambda x: x["i"]))
            step = lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(WINDOW), x - a["p"])).alias("n"))
            start = F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(g)) < F.size(g), _let(pairs, repeated)).otherwise(F.lit(0))

    return _let(_let(words, windows), covered)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with one column for each of MEASURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SEPARATOR), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    by_line = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    own = _others(docs, (*MEASURES, "failed_bits"))
    free = next(n for n in ("_" * k + "counted" for k in range(1, 99)) if not any(c.lower().startswith(n) for c in docs.columns))
    words_of, lines_of = free, free + "_lines"
    out = docs.select(
        *own,
        counted.alias(words_of),
        by_line.alias(lines_of),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    part = {"n_lines": lines_of, "n_dup_lines": lines_of, "n_symbols": None, "n_upper": None}
    return out.select(*own, *(F.col(f"{p}.{m}").alias(m) if (p := part.get(m, words_of)) else F.col(m) for m in MEASURES))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns, measurements, and `failed_bits`: bit i is set where RULES[i] fails."""
    df = measured(docs, text)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return df.select(*_others(df, ("failed_bits",)), bits.alias("failed_bits"))


def _others(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns of a frame but those of some names, in any case of letters."""
    low = {n.lower() for n in names}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in low]


def with_verdict(book: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy; no text is read."""
    failed = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask)) != 0
    return book.select(*_others(book, ("base_failed", "kept")), failed(mask_of("base")).alias("base_failed"), (~failed(mask_of(policy) | mask_of("base"))).alias("kept"))


def ablation(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows failing it, and rows that only it rejects.

    The ledger is first reduced to one row per pattern of failed bits (2^rules at most), so the
    rules are compared on counts alone.
    """
    mask = mask_of(policy)
    names = {r.name: 1 << i for i, r in enumerate(RULES) if mask >> i & 1}
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names.items())))
    rows = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_rows"),
    )


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM base WHERE len(w) >= 3)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n >= 2),
spread AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM base b LEFT JOIN spread s ON b.doc_id = s.doc_id),
f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM f
"""


def ablation_oracle(policy: str = "v2") -> str:
    """DuckDB SQL for the ablation of a policy over the ledger of `documents`."""
    mask = mask_of(policy)
    rules = ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(RULES) if mask >> i & 1)
    return f"""
WITH book AS ({ORACLE}), rules(rule, bit) AS (VALUES {rules})
SELECT rule, CAST(count(*) FILTER (WHERE failed_bits & bit <> 0) AS BIGINT) AS n_failed,
       CAST(count(*) FILTER (WHERE failed_bits & {mask} = bit) AS BIGINT) AS n_only, CAST(count(*) AS BIGINT) AS n_rows
FROM book, rules GROUP BY rule
"""
