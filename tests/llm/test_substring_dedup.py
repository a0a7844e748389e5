import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plandag.llm import substring_dedup as op
from plandag.llm.queries import op2_substring_dedup
from tests.conftest import TESTDATA


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, gone, strict=True) if not y)
        out.append((d, len(t), sum(gone), sum(y and not (i and gone[i - 1]) for i, y in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, length=op.LENGTH, **options):
    return sorted((tuple(r)[:5] for r in op.report(df, length, **options).collect()), key=str)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(docs_of, odd, clashes):
    assert run(docs_of(odd, clashes)) == brute(odd, 400)


def test_empty(docs_of):
    assert run(docs_of([])) == [] and run(docs_of([(1, None), (2, "x")])) == brute([(1, None), (2, "x")], 400)


def texts(seed, n, alphabet, length):
    """Texts pasted from a few passages, so that windows overlap, repeat within a text and differ at their edges."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [word(r.randrange(1, 3 * length)) for _ in range(4)]
    return [(i, "".join(r.choice([r.choice(passages), word(r.randrange(length)), r.choice(passages)[: r.randrange(1, length)]]) for _ in range(r.randrange(5)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(docs_of, seed):
    length, anchor = [(20, 5), (20, 20), (12, 1), (40, 8), (30, 3), (7, 2)][seed]
    rows = texts(seed, 60, "ab" if seed % 2 else "abcdéf", length)
    want = brute(rows, length)
    assert run(docs_of(rows), length, anchor=anchor) == want
    assert run(docs_of(rows), length, anchor=anchor, hot=3) == want
    assert run(docs_of(rows), length, anchor=anchor, hot=1) == want


def test_kept_bytes_and_spans_rebuild_the_text(docs_of):
    rows = texts(9, 30, "abc", 25)
    for r in op.report(docs_of(rows), 25, 6, want_text=True).collect():
        data, kept, at = dict(rows)[r.doc_id].encode(), b"", 0
        for a, b in (map(int, s.split(":")) for s in r.removed.split(",") if s):
            kept, at = kept + data[at:a], b
        assert kept + data[at:] == r.kept and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("seed", range(5))
def test_suffixes_are_sorted(seed):
    r = np.random.default_rng(seed)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    start = r.integers(0, 2900, 300)
    end = np.minimum(start + r.integers(1, 100, 300), 3000)
    group = np.sort(r.integers(0, 20, 300))
    order = op.Suffixes(data, start, end, group).order
    raw = data.tobytes()
    assert order.tolist() == sorted(range(300), key=lambda k: (group[k], raw[start[k] : end[k]], k))


def test_collisions_are_found_out(monkeypatch):
    """With a hash that is always equal, the bytes decide."""
    data = np.frombuffer(b"abcdefabcxyzabcdef", np.uint8)
    begin = np.array([0, 6, 12])
    monkeypatch.setattr(op, "span_hash", lambda p, s, e: np.zeros(len(s), np.uint64))
    monkeypatch.setattr(op.Suffixes, "same", lambda self, a, b, n: np.ones(len(a), bool))
    owner, start, stands = op.repeated(data, begin, begin, np.array([1, 1, 1]), np.zeros(3, np.int64), 6)
    assert stands.tolist() == [0, 1, 0]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA.replace('0.01', '0.001')}/documents.parquet").collect()]
    assert sorted(map(tuple, op2_substring_dedup(spark, TESTDATA.replace("0.01", "0.001")).collect()), key=str) == brute(docs, 400)


@pytest.mark.parametrize("size", [30, 64, 100])
def test_long_texts_in_pieces(docs_of, spark, size, monkeypatch):
    find = op._find
    monkeypatch.setattr(op, "_find", lambda length, anchor: find(length, anchor, size))
    rows = texts(21, 8, "abcd", 25) + [(100, "".join(t for _, t in texts(22, 12, "abc", 25))), (101, None)] + [(102, "".join(t for _, t in texts(22, 12, "abc", 25))[7:])]
    assert run(docs_of(rows), 25, anchor=6) == brute(rows, 25)
