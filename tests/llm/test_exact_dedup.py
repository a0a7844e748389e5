import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plandag.llm import exact_dedup as op
from plandag.llm.queries import OP5_SQL, op5_exact_dedup
from tests.conftest import TESTDATA
from tests.oracle import compare, connect


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    least = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, least[norm(t)], len(groups[norm(t)]), d == least[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows), key=str)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(docs_of, odd, clashes):
    assert sorted(map(tuple, op.report(docs_of(odd, clashes)).collect()), key=str) == brute(odd)


def test_empty(docs_of):
    assert op.report(docs_of([])).collect() == [] and op.drop_copies(docs_of([])).collect() == []


def test_one_row_of_each_group_stays(docs_of, odd):
    df = docs_of(odd, True)
    kept = op.drop_copies(df)
    assert kept.columns == df.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in odd})
    assert {r.doc_id for r in kept.collect() if norm(r.text) == "one two"} == {5}


def test_history_of_choice_gives_the_same(docs_of, spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 7}") for i in range(50)]
    for history in (F.lit(True), F.lit(False), F.col("doc_id") < 20, F.lit(None).cast("boolean")):
        assert sorted(map(tuple, op.report(docs_of(rows), history).collect()), key=str) == brute(rows)


def test_small_shards(docs_of):
    found = op.groups(op.digests(docs_of([(i, f"t{i % 60}") for i in range(100)])), keys_per_shard=3).collect()
    assert len(found) == 60 and sum(r.group_size for r in found) == 100 and {r.known for r in found} == {True, False}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(0, 2**32))
def test_hash_is_perfect_and_minimal(n, seed):
    keys = np.unique(np.random.default_rng(seed).integers(0, 2**64, (n, 4), np.uint64), axis=0)
    made = op.PerfectHash.build(keys)
    assert sorted(made.slots(keys)) == list(range(len(keys)))
    strangers = made.slots(np.random.default_rng(seed + 1).integers(0, 2**64, (50, 4), np.uint64))
    assert ((strangers >= -1) & (strangers < max(1, len(keys)))).all()


def test_query_is_its_sql(spark):
    compare(op5_exact_dedup(spark, TESTDATA), connect(TESTDATA), OP5_SQL)
