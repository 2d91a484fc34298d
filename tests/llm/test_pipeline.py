import collections
import random
import re
import struct
import zlib

import numpy as np
import tokenizers
import xxhash

import corpus_pipeline as p
from awardlens.llm import cnn, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def corpus():
    rnd = random.Random(12)
    words = ["".join(rnd.choice(("an", "er", "the", "on", "ti", "re", "sol")) for _ in range(rnd.randint(1, 4))) for _ in range(900)]
    rows, labels, clean, groups = [], [], [], []
    for k in range(150):
        base = [rnd.choice(words) for _ in range(rnd.randint(120, 260))]
        i = 10 * k
        if k % 5 == 0:
            base = [f"{w.upper()}!!" if k % 2 else f"{w}&&&" for w in base]
        elif k % 5 == 1:
            group = [i, i + 1, i + 2]
            rows.append((i + 1, " ".join(base), "en", "s1", 1))
            rows.append((i + 2, " ".join([*base[:50], "changed", *base[51:]]), "en", "s0", 1))
            groups.append(group)
        else:
            clean.append(i)
        rows.append((i, " ".join(base), "en", f"s{k % 3}", 1))
        labels.append((i, int(k % 5 != 0), 0))
    return [*rows, (9000, None, None, None, 0), (9001, "", "en", "s1", 0), (9002, "too short", "en", "s1", 9)], labels, clean, groups


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_clean_documents_and_one_of_each_group(spark, tmp_path):
    rows, labels, clean, groups = corpus()
    folder = tables(spark, tmp_path / "in", rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        if k < 4:
            assert docs.columns == columns
    kept = ids(seen["simhash_near_dedup"])
    assert len(kept) == len(set(kept)) and not {9000, 9001, 9002} & set(kept)
    assert set(clean) - set(kept) == set()
    assert all(set(g) & set(kept) == {min(g)} for g in groups)
    assert ids(seen["source_mixing"]) == kept
    texts = {r.doc_id: r.text for r in seen["source_mixing"].collect()}
    found = {}
    for r in docs.collect():
        assert zlib.crc32(r.ids) == r.ids_crc32
        found.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    encoder = packing.WordEncoder(packing.default_tokenizer())
    for i, t in texts.items():
        want = np.frombuffer(encoder.encode(t.encode()), encoder.kind).tolist() + [1]
        assert [x for _, part in sorted(found[i]) for x in part] == want


def test_packing_follows_the_mixed_order(spark, tmp_path):
    rows = [(i, f"text number {i}", "en", f"s{i % 3}", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    p.mixing_stage(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    from awardlens.llm import mixing

    want = [r.doc_id for r in mixing.mixed(docs).orderBy("position").collect()]
    got = [r.doc_id for r in p.packing_stage(spark, mixed, "").where("start = 0").orderBy("sequence_id", "offset").collect()]
    assert got == want


def test_run_on_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path / "none", [], [])
    assert p.run(spark, folder).count() == 0


def plain_quality(text):
    """All seven rules by plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    chars, n = sum(map(len, words)), len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = (n < 50, 100 * len(covered) > 50 * n, 10 * symbols > 3 * n, 2 * (len(lines) - len(set(lines))) > len(lines), 2 * sum(c.isupper() for c in text) > chars, chars > 30 * n, chars < 2 * n)
    return not any(failed)


def plain_score(net, text):
    """The network by windows, segments and chunks of one text."""
    data, n = text.encode(), max(1, -(-len(text.encode()) // cnn.STRIDE))
    padded = np.frombuffer(data + bytes(cnn.STRIDE * n + cnn.WIDTH - len(data)), dtype=np.uint8)
    out = np.array([sum(net.e[padded[cnn.STRIDE * i + k]] @ net.w[k] for k in range(cnn.WIDTH)) for i in range(n)])
    seg = [out[a : a + cnn.SEGMENT].max(0) for a in range(0, n, cnn.SEGMENT)]
    chunks = [np.maximum(x, y) for x, y in zip(seg, seg[1:], strict=False)] or seg
    v = np.concatenate([np.max(seg, 0) + net.b, np.mean(chunks, 0) + net.b, np.min(chunks, 0) + net.b, [np.log(n) - 5]])
    return 1 / (1 + np.exp(-(np.tanh(v @ net.a + net.a0) @ net.o + net.o0)[0]))


def plain_dedup(rows):
    """Rows by id: one goes if its shingle set is, or is like, that of a row that stays."""
    kept = []
    for row in sorted(rows):
        words = row[1].lower().split()
        own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        if not any(own == s or len(own & s) >= 0.8 * len(own | s) for _, s in kept):
            kept.append((row, own))
    return [row for row, _ in kept]


def plain_mix(rows):
    """Slot by slot: of the sources whose next block is released the one with the earliest deadline."""

    def spread(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), xxhash.xxh64_intdigest(struct.pack("<q", row[0]), 42))
        h -= (h >> 63) << 64
        return h % 64, h, row[0]

    by = {}
    for row in sorted(rows, key=spread):
        by.setdefault(row[3], []).append(row)
    total = sum(len(v) ** 0.5 for v in by.values())
    weight = {s: max(1, round(10_000 * len(v) ** 0.5 / total)) for s, v in by.items()}
    left = {s: [v[i : i + 16] for i in range(0, len(v), 16)] for s, v in by.items()}
    out, placed, slot = [], dict.fromkeys(by, 0), 0
    while any(left.values()):
        live = sorted(s for s in left if left[s])
        period = sum(weight[s] for s in live)
        ready = [(-(-(placed[s] + 1) * period // weight[s]), s) for s in live if placed[s] * period // weight[s] <= slot]
        _, s = min(ready)
        out += left[s].pop(0)
        placed[s], slot = placed[s] + 1, slot + 1
        if not left[s]:  # the others' weights are scaled up and all begin anew
            placed, slot = dict.fromkeys(by, 0), 0
    return out


def plain_pack(rows):
    encoder, at, out = tokenizers.Tokenizer.from_file(packing.default_tokenizer()), 0, []
    for doc_id, text, *_ in rows:
        ids = [*encoder.encode(text, add_special_tokens=False).ids, 1]
        start = 0
        while start < len(ids):
            length = min(2048 - at % 2048, len(ids) - start)
            part = ids[start : start + length]
            out.append((doc_id, start, length, zlib.crc32(struct.pack(f"<{length}I", *part)), len(ids), at // 2048, at % 2048))
            start, at = start + length, at + length
    return out


def test_run_gives_what_plain_python_gives(spark, tmp_path):
    rows, labels, _, _ = corpus()
    folder = tables(spark, tmp_path / "in", rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    net = cnn.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r in rows if plain_quality(r[1])]
    scores = {r[0]: plain_score(net, r[1]) for r in good}
    assert all(abs(x - p.KEEP_SCORE) > 1e-4 for x in scores.values())  # float32 in tasks
    mixed = plain_mix(plain_dedup([r for r in good if scores[r[0]] >= p.KEEP_SCORE]))
    assert 50 < len(mixed) < len(good) < len(rows)
    wanted = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    got = sorted((tuple(r) for r in p.run(spark, folder).select(*wanted).collect()), key=lambda r: r[5:])
    assert got == plain_pack(mixed)
