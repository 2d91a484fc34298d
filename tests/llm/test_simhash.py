import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from awardlens.llm import simhash
from awardlens.llm import text as text_module
from awardlens.llm.components import components
from awardlens.llm.leaders import led

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, errors=3):
    prints = {}
    for i, t in rows:
        prints.setdefault(brute_fingerprint(t), []).append(i)
    keys = list(prints)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= errors:
                parent[find(a)] = find(b)
    low = {}
    for k in keys:
        low[find(k)] = min([*prints[k], low.get(find(k), 10**9)])
    return {(i, f"{k:016x}", low[find(k)]) for k in keys for i in prints[k]}


def fixture():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  \t\n"), (3, "ONE two"), (4, "one two")]
    for k in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 300))]
        rows.append((10 + 10 * k, " ".join(base)))
        for j in range(rnd.randint(0, 4)):
            copy = list(base)
            if j:
                copy[rnd.randrange(len(copy))] = "edited"
            rows.append((11 + 10 * k + j, " ".join(copy)))
    return rows


def test_components_of_fingerprints_match_brute_force(spark):
    rows = fixture()
    got = simhash.near_components(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {tuple(r) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_repeated_rows_null_ids_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 1), (1, "a b c d", 2), (None, "a b c d", 3)], "doc_id long, text string, fp int")
    got = simhash.near_components(df).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 1), (False, 1), (True, 1)]
    assert simhash.near_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_walk_finds_every_pair_within_the_budget():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    rows = [int(b) for b in base]
    for b in base:
        for flips in (1, 3, 4, 9):
            x = int(b)
            for bit in rnd.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            rows.append(x)
    rows = sorted(set(rows))
    fps = np.array(rows, dtype=np.uint64)[:, None]
    zero = np.zeros(len(rows), dtype=np.int64)
    links = simhash.Links(len(rows))
    for block in range(4):
        turned = simhash._rotated(fps, block, 4)
        root = simhash.trie_links(turned, zero, zero, simhash.Budget(16, 2), (simhash.Budget(64, 9),), frontier=64)
        links.add(np.arange(len(rows)), root)
    want = simhash.Links(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i] ^ rows[j]).count("1") <= 9:
                want.add(np.array([i]), np.array([j]))
    assert np.array_equal(links.root, want.root)


def test_two_sided_groups_meet_across_only():
    fps = np.array([[8], [8], [9], [9]], dtype=np.uint64)
    root = simhash.trie_links(fps, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 0]), simhash.Budget(16, 1), (simhash.Budget(64, 1),))
    assert list(root) == [0, 0, 2, 2]


def test_dedup_keeps_one_of_each_group_and_all_clean_rows(spark):
    rnd = random.Random(11)
    words = [f"t{i}" for i in range(3000)]
    rows, clean, groups = [], [], []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(260)]
        rows.append((100 * k, " ".join(base)))
        if k % 3:
            clean.append(100 * k)
            continue
        group = [100 * k]
        for j in range(1, 4):
            copy = list(base)
            for _ in range(j - 1):
                copy[rnd.randrange(260)] = "changed"
            rows.append((100 * k + j, " ".join(copy)))
            group.append(100 * k + j)
        groups.append(group)
    rows += [(7, None), (8, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("level", F.lit(1))
    kept = {r.doc_id for r in simhash.keep_one_of_each(df).collect()}
    assert set(clean) <= kept
    assert all(len(kept & set(g)) == 1 and min(g) in kept for g in groups)
    assert 7 in kept and 8 not in kept


def test_dedup_of_null_and_clashing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    df = spark.createDataFrame([(None, a), (None, b), (None, a), (4, c), (4, c), (4, b), (-2, c)], SCHEMA)
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in simhash.keep_one_of_each(df).collect())
    assert kept == [(False, 0, a), (True, -2, c), (True, 4, b)]
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def test_dedup_is_the_greedy_choice_by_exact_jaccard_and_keeps_other_columns(spark):
    rnd = random.Random(21)
    words = [f"v{i}" for i in range(4000)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 8)):  # of every likeness, and copies of copies
            base = list(base)
            for _ in range(rnd.choice((0, 1, 2, 5, 9))):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            texts.append(" ".join(base))
    order = list(range(len(texts)))
    rnd.shuffle(order)
    sets = {i: {tuple(texts[k].split()[j : j + 5]) for j in range(196)} for i, k in enumerate(order)}
    stay = []
    for i in sets:
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in stay):
            stay.append(i)
    names = ["_th", "_s", "key", "row", "name", "level", "block", "set"]
    df = spark.createDataFrame([(i, texts[k], *(f"{n}{i}" for n in names)) for i, k in enumerate(order)], ["doc_id", "text", *names])
    got = simhash.keep_one_of_each(df).collect()
    assert sorted(r.doc_id for r in got) == stay
    assert all(r["_th"] == f"_th{r.doc_id}" and r["name"] == f"name{r.doc_id}" for r in got) and got[0].__fields__ == df.columns


def test_many_rounds_and_pieces_give_the_same_leaders(spark):
    rnd = random.Random(5)
    sets = {f"n{i:03}": sorted(rnd.sample(range(40), 30)) for i in range(120)}
    want, stay = {}, []
    for n in sorted(sets):
        reached = [m for m in stay if len(set(sets[n]) & set(sets[m])) >= 0.75 * len(set(sets[n]) | set(sets[m]))]
        want[n] = min(reached, default=n)
        stay += [] if reached else [n]
    df = spark.createDataFrame([("g", n, s) for n, s in sets.items()], "root string, node string, set array<long>")
    got = {r.node: r.leader for r in led(df, 0.75, first=2, piece_rows=10).collect()}
    assert {n for n, m in got.items() if n == m} == set(stay)
    assert all(m in stay and len(set(sets[n]) & set(sets[m])) >= 0.75 * len(set(sets[n]) | set(sets[m])) for n, m in got.items())


def test_long_texts_give_the_fingerprint_of_short_pieces(monkeypatch):
    text = " ".join(f"w{i % 77}x{i}" for i in range(500)).encode()
    want = simhash.fingerprint(text, 3)
    monkeypatch.setattr(text_module, "WORD_BYTES", 50)
    assert simhash.fingerprint(text, 3) == want


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    edges = [(f"{rnd.randrange(300):03}", f"{rnd.randrange(300):03}") for _ in range(220)]
    edges += [(f"{i:03}", f"{i + 1:03}") for i in range(400, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {(x, find(x)) for x in parent}


def classes(nodes, links):
    return {(r.fp, r.root) for r in simhash.linked_classes(nodes, links).collect()}


@pytest.mark.parametrize("cap", [1 << 16, 3])
def test_nodes_over_the_cap_lose_no_link(spark, cap):
    rnd = np.random.default_rng(8)
    centre = int(rnd.integers(0, 2**63))
    values = {centre}
    for _ in range(60):  # a hot group around one fingerprint, all of whose blocks are hot nodes
        values.add(centre ^ sum(1 << int(b) for b in rnd.choice(64, 3, replace=False)))
    values |= {int(v) for v in rnd.integers(0, 2**63, 40)}
    keys = sorted(values)
    prints = spark.createDataFrame([(i, f"{v:016x}", 9) for i, v in enumerate(keys)], "doc_id long, fp string, n_shingles long")
    nodes = simhash.nodes_of(prints)
    got = {(r.fp, r.component_id) for r in simhash.linked_classes(nodes, simhash.hamming_links(nodes, cap=cap)).collect()}
    parent = list(range(len(keys)))
    for _ in range(len(keys)):
        for i in range(len(keys)):
            for j in range(len(keys)):
                if (keys[i] ^ keys[j]).bit_count() <= 3:
                    parent[i] = min(parent[i], parent[j])
    assert got == {(f"{v:016x}", parent[i]) for i, v in enumerate(keys)}


def test_similarity_links_do_not_depend_on_the_cap(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(25):
        base = rnd.getrandbits(256)
        for _ in range(rnd.randint(1, 12)):
            near = base
            for bit in rnd.sample(range(256), rnd.randint(0, 20)):
                near ^= 1 << bit
            rows.append((len(rows), f"{near:064x}", rnd.choice([100, 110, 120, 900])))
    nodes = simhash.nodes_of(spark.createDataFrame(rows, "doc_id long, fp string, n_shingles long"))
    whole = classes(nodes, simhash.similarity_links(nodes))
    assert classes(nodes, simhash.similarity_links(nodes, cap=4)) == whole
    assert 25 < len({root for _, root in whole}) < len(rows)


def test_tasks_stay_whole_over_batches():
    tasks = [0, 0, 0, 1, 1, 2, 5, 5, 5, 5, 5, 6, 7]
    for size in (1, 2, 3, 5, 20):
        batches = [pa.RecordBatch.from_pydict({"task": pa.array(tasks[i : i + size], pa.int64())}) for i in range(0, len(tasks), size)]
        for least in (1, 2, 4, 100):
            found = [t.column("task").to_pylist() for t in simhash.whole_tasks(iter(batches), least)]
            assert sum(found, []) == tasks
            assert all(a[-1] != b[0] for a, b in zip(found, found[1:], strict=False))
            assert all(len(f) >= least for f in found[:-1])
    assert list(simhash.whole_tasks(iter([]))) == []
