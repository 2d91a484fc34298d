import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from awardlens.llm import packing as p
from awardlens.llm import text as text_module

SCHEMA = "doc_id long, text string"
ODD = ["DON'T can't 's 'S it's,ok'll", "é, É! ÉÉ×÷ naïve… “quoted”! «x»", "H̱ é É Å", "x²3 ½ 12,345.67", "<|startoftext|>a<|ENDOFTEXT|> B", "İstanbul ΣΑΣ ς ﬁ", "a\x1cb\x85c d　e", "日本語、テスト。", "łódź,ŁÓDŹ ñandú?¿Qué", "\x00\x01a\x7fb", "𝔘𝔫𝔦 😀!😀a", "a-b_c|d&&&%%%***", "WORD''s '", "ÀÖØöøÿ,×a÷b"]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(p.default_tokenizer())


def plain(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def texts():
    rnd = random.Random(1)
    letters = "abcXYZéÉß×ñ,.!'*<|> \n\t²ł“́"
    return [None, "", " \n ", *ODD, " ".join(f"Word{i % 700}," for i in range(9000)), *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 400))) for _ in range(150))]


def test_units_and_words_give_the_tokenizers_own_ids():
    e = p.WordEncoder(p.default_tokenizer())
    t = Tokenizer.from_file(p.default_tokenizer())
    for text in texts():
        got = np.frombuffer(e.encode((text or "").encode()), dtype=e.kind).tolist()
        assert got == t.encode(text or "", add_special_tokens=False).ids, text


def test_pieces_are_an_exact_round_trip(spark):
    rows = list(enumerate(texts()))
    got = p.pieces(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in rows:
        joined = [x for _, ids, _ in sorted(by_doc[i]) for x in ids]
        assert joined == plain(t) and {n for _, _, n in by_doc[i]} == {len(joined)}
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == p.WINDOW or s == last


def test_repeated_rows_null_ids_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, None, 4)], "doc_id long, text string, start int")
    got = p.pieces(df).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 2), (1, 2)]
    assert p.pieces(spark.createDataFrame([], SCHEMA)).count() == 0


def gapless(got, want):
    """Every document's pieces are its ids, and every sequence is filled from 0 without overlap."""
    parts, lines = {}, {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        lines.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        assert [x for _, part in sorted(parts[i]) for x in part] == ids
    assert sorted(lines) == list(range(len(lines)))
    for k, spans in lines.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == p.WINDOW or k == len(lines) - 1


FRAMES = {
    "plain": lambda d: d,
    "repartitioned": lambda d: d.repartition(8),
    "sorted": lambda d: d.orderBy("doc_id"),
    "joined": lambda d: d.join(d.select("doc_id", F.length("text").alias("n")), "doc_id"),
    "union": lambda d: d.where("doc_id % 2 = 0").union(d.where("doc_id % 2 = 1")),
}


@pytest.mark.parametrize("frame", FRAMES)
def test_offsets_hold_whatever_exchanges_a_file_frame_has(spark, tmp_path, frame):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(("alpha", "beta", "gamma,", "d")) for _ in range(rnd.randint(0, 900))), i, "x") for i in range(200)]
    spark.createDataFrame(rows, SCHEMA + ", split long, place string").repartition(5).write.parquet(f"{tmp_path}/docs")
    want = {i: plain(t) for i, t, *_ in rows}
    docs = spark.read.parquet(f"{tmp_path}/docs")
    gapless(p.pieces(FRAMES[frame](docs)).collect(), want)
    if frame in ("plain", "repartitioned", "sorted"):
        gapless(p.pieces(FRAMES[frame](docs), place=("_metadata.file_path", "_metadata.file_block_start")).collect(), want)


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(p, "CACHE_WORDS", 3)
    e = p.WordEncoder(p.default_tokenizer())
    assert np.frombuffer(e.encode(b"one two three four five six"), dtype=e.kind).tolist() == plain("one two three four five six")[:-1]
    monkeypatch.setattr(p, "CACHE_UNITS", 3)
    e = p.WordEncoder(p.default_tokenizer())
    assert np.frombuffer(e.encode(b"one don't two's three four five six"), dtype=e.kind).tolist() == plain("one don't two's three four five six")[:-1]
    assert len(e.units) <= 3 and len(e.cache) <= 3


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    text = " ".join(["plain, words", "Don't", "é×", "<|startoftext|>", "ÉA"][i % 5] for i in range(300))
    monkeypatch.setattr(text_module, "WORD_BYTES", 40)
    e = p.WordEncoder(p.default_tokenizer())
    assert np.frombuffer(e.encode(text.encode()), dtype=e.kind).tolist() == plain(text)[:-1]


@pytest.mark.parametrize(("used", "want"), [(2048, 2048), (1024, 1024), (1, 1), (3, 2048), (1500, 2048)])
def test_padding(used, want):
    assert p.padded_length(used) == want
