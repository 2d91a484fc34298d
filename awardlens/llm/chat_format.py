"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only that
reply is trainable. A conversation that does not end with a reply gives one more example without a
trainable part, so that no turn is lost. A template marks the turns; control strings inside roles
and texts are escaped, so that an example can be read back exactly.

Escaping: a backslash is doubled, the first character of a control string becomes `\\l` (for `<`) or
`\\b` (for `[`), a line break in a role becomes `\\n`. Control strings are everything that starts
with `<|`, and `<s>`, `</s>`, `<<SYS>>`, `<</SYS>>`, `[INST]`, `[/INST]` of other templates, so an
escaped text holds no string that a tokenizer may take for a mark.

Defined results: turns go by `turn`, nulls first, ties by role and text; a null role or text is
empty; repeated rows are turns of their own; rows without a conversation id are one conversation
with a null id; an empty table gives no examples; columns other than the four are left out, whatever
their names. The turns of one conversation meet in one row, since an example is one value (up to
Spark's 2 GB); examples are made one at a time from it, so their number costs no memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn: opening, role, line break, text, closing."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    trained_role: str = "assistant"

    def __post_init__(self):
        if not (self.opening.startswith("<|") and self.closing.startswith("<|")):
            raise ValueError("marks must start with '<|', which is escaped everywhere else")


CONTROL_LT = r"<(?=\||/?s>|</?SYS>>)"
CONTROL_SB = r"\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    """A text without control strings."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, CONTROL_LT, r"\\l"), CONTROL_SB, r"\\b")


def escaped_role(role: Column) -> Column:
    """A role without control strings or line breaks."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """What `escaped` or `escaped_role` was given. Between doubled backslashes, single ones start a code."""
    codes = (("\\l", "<"), ("\\b", "["), ("\\n", "\n"))

    def decoded(part: Column) -> Column:
        for code, plain in codes:
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    whole = F.array_join(F.transform(F.split(text, r"\\\\"), decoded), "\\")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def examples(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each reply: conv_id, example (its turn, from 1), last, text, loss_start, loss_chars.

    `text` is the formatted context with the reply; code points loss_start (from 0) and loss_chars on
    are under the loss mask. `last` marks the example that holds the whole conversation; where that
    ends without a reply, nothing of it is under the mask.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    drawn = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(template.opening), escaped_role(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == template.trained_role).alias("trained"),
        ),
    )
    marked = held.select("conv_id", drawn.alias("turns"))
    wanted = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["trained"] | (i == F.size("turns")))
    expanded = marked.select("conv_id", "turns", F.explode(wanted).alias("example"))
    own = F.get("turns", F.col("example") - 1)
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("example")), lambda t: F.concat(t["head"], t["body"], F.lit(template.closing))), "")
    reply = F.when(own["trained"], F.length(own["body"])).otherwise(0)
    made = expanded.select("conv_id", "example", (F.col("example") == F.size("turns")).alias("last"), text.alias("text"), reply.cast("long").alias("loss_chars"))
    # in a step of its own, so that a text is put together once
    start = (F.length("text") - len(template.closing) - F.col("loss_chars")).cast("long")
    return made.select("conv_id", "example", "last", "text", start.alias("loss_start"), "loss_chars")


def read_back(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted example."""
    turns = F.slice(F.split(text, rf"\Q{template.opening}\E"), 2, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        start = F.length(role) + 2
        body = F.substring(x, start, F.length(x) - len(template.closing) - start + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, turn)


def under_mask(text: Column, start: Column, chars: Column) -> Column:
    """The trainable text of a formatted example."""
    return unescaped(F.substring(text, start.cast("int") + 1, chars.cast("int")))


def digest(made: DataFrame, template: Template = Template()) -> DataFrame:
    """What can be read back from the examples of each conversation."""
    turns = read_back(F.col("text"), template)
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        under_mask(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.when(F.col("last"), F.size(turns)).cast("long").alias("n_turns"),
        F.when(F.col("last"), F.sha2(whole, 256)).alias("turns_sha256"),
    )
    found = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: The contract's own conversation: control strings of another template inside its texts.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length(text) + length(role) + 12 + 1 + 11
      + len(regexp_extract_all(text, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]'))
      + len(regexp_extract_all(role, '\\|\n|<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, role = 'assistant' AS trained FROM sized)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE trained), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE trained), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE trained OR i = n) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (WHERE trained OR i = n) AS BIGINT) AS n_examples
FROM summed GROUP BY conv_id
"""
