import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plandag.llm import textkit as op

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z9.é日\n", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_of_blocks_are_those_of_each_text(texts, size):
    got = []
    for b in op.blocks(pa.array(texts, pa.string()), size, lower=True):
        w = op.words(b)
        h = op.word_hashes(b, w)
        assert len(set(h.tolist())) == len({b.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)})
        for k in range(len(b.starts)):
            i, j = w.first[k : k + 2]
            assert (w.row[i:j] == k).all()
            got.append([b.data[s:e].tobytes().decode() for s, e in zip(w.start[i:j], w.end[i:j], strict=True)])
    assert got == [re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams_stay_within_texts(texts, n):
    for b in op.blocks(pa.array(texts, pa.string())):
        w = op.words(b)
        value, at = op.grams(op.word_hashes(b, w), w.row, n)
        words = [b.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
        want = [tuple(words[k : k + n]) for k in range(len(words) - n + 1) if w.row[k] == w.row[k + n - 1]]
        assert len(value) == len(want) and len(set(value.tolist())) == len(set(want))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=80), st.integers(1, 20), st.integers(1, 12))
def test_groups_stay_whole(keys, size, rows):
    keys = sorted(keys)
    batches = [pa.record_batch([pa.array(keys[k : k + size])], ["k"]) for k in range(0, len(keys), size)]
    got = [t["k"].to_pylist() for t in op.whole_groups(iter(batches), "k", rows)]
    assert sum(got, []) == keys
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))


def test_rows_round_trip():
    x = np.arange(12, dtype=np.uint64).reshape(4, 3)
    assert (op.rows_of(op.binary_rows(x), np.uint64, 3) == x).all()
    assert op.rows_of(op.binary_rows(x[:0]), np.uint64, 3).shape == (0, 3)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_word_hashes_do_not_depend_on_pieces(texts, piece):
    for b in op.blocks(pa.array(texts, pa.string())):
        w = op.words(b)
        assert (op.word_hashes(b, w, piece) == op.word_hashes(b, w)).all()
