import math
import random
import re

from awardlens.llm import license_scan as op
from awardlens.llm import text as text_module

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w, found = words(text), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def brute_labels(text, threshold=0.8):
    labels, best, w = set(), 0.0, words(text)
    for label, notice, needs, bars, *around in op.TEMPLATES:
        t, needs, bars = words(notice), words(needs), set(words(bars))
        need = math.ceil(threshold * len(set(t)) - 1e-9)
        window = 2
        while window < 2 * len(t):
            window *= 2
        for at in range(0, max(1, len(w) - window // 2), window // 2):
            block = w[at : at + window]
            if set(words(" ".join(around))) & set(block):
                continue
            length = min(len(t), len(block))
            for k in range(len(block) - length + 1):
                s = block[k : k + length]
                beside = [w[at + k - 1]] if at + k and s and s[0] in needs else []
                beside += w[at + k + length : at + k + length + 1] if s and s[-1] in needs else []
                rest = iter(s)
                if len(set(t) & set(s)) >= need and not bars & {*s, *beside} and all(n in rest for n in needs):
                    labels.add(label)
                    best = max(best, len(set(t) & set(s)) / len(set(t)))
    return labels, best


def texts():
    rnd = random.Random(8)
    filler = "of the work in and to license version under software é straße 12 a rights public".split()
    out = [None, "", " ,. ", "CC-BY 4.0, cc by; CC BY\nall\nrights reserved", "caféCC BY", "All rights reserved. ALL RIGHTS RESERVED", "GNU general  public-license v3"]
    for _, t, *_ in op.TEMPLATES:
        w = t.split()
        for drop in (0, 1, 2, 3):
            kept = [x for i, x in enumerate(w) if i not in set(rnd.sample(range(len(w)), min(drop, len(w) - 1)))]
            noise = [rnd.choice(filler) for _ in range(rnd.choice((0, 5, 90, 200)))]
            at = rnd.randint(0, len(noise))
            out.append(" ".join(noise[:at] + kept + noise[at:]) + rnd.choice(("", "\nmore text")))
    return out + ["the of and in to a " * 300]


def test_scan_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in op.digest(op.scan(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        base = brute_base(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base, t
        labels, best = brute_labels(t)
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, base[4].split(","))), t
        assert abs(r.score - (1.0 if base[1] else best)) < 1e-9


NOTICES = {
    "This work is licensed under the GNU General Public License": "gpl",
    "This file is licensed under the GNU General Public License, version 2 or later.": "gpl",
    "The library is licensed under the GNU Lesser General Public License, version 2.1": "lgpl",
    "The server is licensed under the GNU Affero General Public License v3": "agpl",
    "Licensed under CC BY 4.0": "cc-by",
    "The text is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License": "cc-by-sa",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "licensed under a Creative Commons Attribution-NonCommercial 4.0\nInternational License": "cc-by-nc",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
    "released under the license": "",
    "subject to the terms of the Apache Public License": "",
    "subject to the terms of the Mozilla Public License, v. 2.0": "mpl",
    "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\nsoftware and associated documentation files": "mit",
    "Released under the MIT\nLicense.": "mit",
    "we were all granted the right to use the reserved seats": "",
}


def test_each_notice_gives_its_own_label_alone(spark):
    filler = "plain prose of no license stands here and goes on for a while ".split()
    rows = [(2 * i, t) for i, t in enumerate(NOTICES)] + [(2 * i + 1, " ".join(filler * 9 + [t] + filler * 30)) for i, t in enumerate(NOTICES)]
    found = op.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in found:
        t, label = list(NOTICES.items())[r.doc_id // 2]
        assert {m.label for m in r.matches} == set(filter(None, [label])), (t, r.matches)


BESIDE = {
    "Licensed under CC BY-SA 4.0. Licensed under CC BY-NC 4.0.": "cc-by-nc cc-by-sa",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0.": "cc-by-nc cc-by-sa",
    "Licensed under CC BY-ND 4.0 or Licensed under CC BY-SA 4.0": "cc-by-nd cc-by-sa",
    "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.": "cc-by cc-by-sa",
    "Licensed under CC BY-SA. Licensed under CC BY 4.0.": "cc-by",  # five of seven words are too few for the first
    "licensed under the GNU Affero General Public License; licensed under the GNU Lesser General Public License": "agpl lgpl",
    "licensed under the GNU Lesser General Public License or licensed under the GNU Affero General Public License": "agpl lgpl",
    "licensed under the GNU General Public License. The library is licensed under the GNU Lesser General Public License.": "gpl lgpl",
    "Licensed under CC BY-NC-SA 4.0 and Licensed under CC BY-NC-ND 4.0": "cc-by-nc-nd cc-by-nc-sa",
}


def test_notices_side_by_side_keep_their_own_labels(spark):
    filler = "plain prose of no license stands here and goes on for a while ".split()
    rows = [(2 * i, t) for i, t in enumerate(BESIDE)] + [(2 * i + 1, " ".join(filler * 7 + [t] + filler * 9)) for i, t in enumerate(BESIDE)]
    for r in op.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        t, labels = list(BESIDE.items())[r.doc_id // 2]
        assert {m.label for m in r.matches} == set(labels.split()), (t, r.matches)


def test_a_megabyte_of_one_phrase_is_scanned(spark):
    text = "All rights reserved. " * 50_000
    [row] = op.digest(op.scan(spark.createDataFrame([(1, text)], SCHEMA))).collect()
    assert (row.n_base, row.n_words, row.labels, row.score) == (50_000, 150_000, "reserved", 1.0)


def test_clashing_columns_are_not_read(spark):
    rows = [(1, "Licensed under CC BY-SA 4.0", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int").withColumns({"a.b": op.F.lit(1), "ROW": op.F.lit(2), "Found": op.F.lit(3), "n_words": op.F.lit(4)})
    assert [r.labels for r in op.digest(op.scan(df)).collect()] == ["cc-by,cc-by-sa"]


def test_whole_license_texts_are_found_wherever_they_stand(spark):
    filler = ("word " * 7).split()
    long = [(label, text) for label, text, *_ in op.TEMPLATES if len(text.split()) > 60]
    rows = [(i * 10 + k, " ".join(filler * k * 5 + text.split() + filler * 90)) for i, (_, text) in enumerate(long) for k in range(5)]
    for r in op.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        assert long[r.doc_id // 10][0] in {m.label for m in r.matches if m.containment == 1.0}


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "plain CC BY text, All rights\nreserved. General public license! " * 40
    order = {w: i for i, w in enumerate((b"cc", b"public", b"rights"))}
    want = op.read(text.encode(), order)
    monkeypatch.setattr(text_module, "WORD_BYTES", 30)
    assert [*map(sorted, op.read(text.encode(), order)[1:])] == [*map(sorted, want[1:])] and op.read(text.encode(), order)[0] == want[0]


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "All rights reserved", 1), (1, "All rights reserved", 1), (None, "x", 2)], "doc_id long, text string, row int")
    got = op.digest(op.scan(df)).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in got) == [(0, ""), (1, "reserved"), (1, "reserved")]
    assert op.scan(spark.createDataFrame([], SCHEMA)).count() == 0
