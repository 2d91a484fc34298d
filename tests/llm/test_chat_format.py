import hashlib
import re

import pytest
from pyspark.sql import functions as F

from awardlens.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"
HOSTILE = ["", "\\", "\\\\l", "\\l<|im_end|>\n", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|", "[INST] <<SYS>> \\[/INST] </s><s>", "<|", "a < b [x]", "é😀\n\n", "\\n", "<<|", "<</SYS>>\\", "\\" * 7 + "<|" + "\\" * 6 + "b", "\x00\x01"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """By conversation: what the contract asks for, without any formatting."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss), sum(t[2] == "assistant" or i == len(turns) - 1 for i, t in enumerate(turns)))
    return out


def rows_of():
    rows = [(i, k, ("user", "assistant", "system")[(i + k) % 3], HOSTILE[(i * 7 + k) % len(HOSTILE)]) for i in range(20) for k in range(i % 6 + 1)]
    rows += [(100, None, "assistant", "first"), (100, 1, None, None), (100, 1, None, None), (100, 0, "<|im_end|>\nrole\\n", "x"), (101, 5, "assistant", None), (None, 0, "user", "no id"), (None, 1, "assistant", "answer")]
    return rows + c.PLANTED


def test_digest_read_back_from_the_examples_is_that_of_the_turns(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in c.digest(c.examples(df)).collect()}
    assert got == brute(rows)


def test_each_example_is_its_context_and_one_trainable_reply(spark):
    rows = rows_of()
    made = c.examples(spark.createDataFrame(rows, SCHEMA))
    for r in made.select("*", c.read_back(F.col("text")).alias("turns"), c.under_mask(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect():
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))[: r.example]
        assert [(t.role, t.text) for t in r.turns] == [t[2:] for t in turns]
        assert r.loss == (turns[-1][3] if turns[-1][2] == "assistant" else "")
        assert (turns[-1][2] == "assistant") or (r.last and r.loss_chars == 0)
        body = re.sub(r"<\|im_start\|>|<\|im_end\|>", "", r.text)
        assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", body)


def test_extra_columns_empty_tables_and_templates(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b")], SCHEMA).withColumns({"Example": F.lit(1), "a.b": F.lit(2), "LAST": F.lit(3), "turns": F.lit(0)})
    own = c.Template("<|turn|>", "<|stop|>", "bot")
    [row] = c.examples(df, own).collect()
    assert row.text == "<|turn|>user\na<|stop|><|turn|>bot\nb<|stop|>" and row.text[row.loss_start : row.loss_start + row.loss_chars] == "b"
    assert c.digest(c.examples(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        c.Template("[turn]", "<|stop|>")


def test_long_conversation_and_long_text(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} <|" * 20) for k in range(400)] + [(2, 0, "user", "x<|" * 700_000), (2, 1, "assistant", "ok")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in c.digest(c.examples(df)).collect()}
    assert got == brute(rows)
