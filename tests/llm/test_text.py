import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from awardlens.llm import text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\rab é漢\x1c\x85\xa0", max_size=30), max_size=6))
def test_words_are_those_of_a_split(texts):
    raw = [t.encode() for t in texts]
    h, n = text.word_hashes(raw)
    words = [t.split() for t in raw]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(h) == len(flat)
    by_word = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_place_or_batch():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 30))).encode() for _ in range(5000)]
    together, _ = text.word_hashes([b" ".join(words)])
    alone = np.concatenate([text.word_hashes([w])[0] for w in words[:200]])
    assert np.array_equal(together[:200], alone)
    assert len(np.unique(together)) == len(set(words))


def test_slices_cover_all_rows_within_the_limit():
    texts = [b"x" * n for n in (5, 0, 100, 3, 3, 3, 50, 0)]
    parts = list(text.slices(texts, 12))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(texts)))
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= 12 for a, b in parts)
    assert list(text.slices([], 5)) == []
