import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plandag.llm import quality as op
from plandag.llm.queries import op10_quality
from plandag.llm.textkit import blocks
from tests.conftest import TESTDATA
from tests.llm.conftest import prose


def walk(model, x):
    """One tree, one row at a time."""
    out = []
    for row in x:
        total = model.start
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if row[f[k]] > t[k] else 1)
            total += leaf[k - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_flat_trees_equal_walking():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = op.fit(x, y, trees=20)
    assert np.allclose(model.score(x), walk(model, x))
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def plain_boosting(x, y, trees, depth, rate, bins, least, ridge):
    """Every cut of every feature of every node is tried, one row at a time. The raw score of each row."""
    cuts = [sorted({sorted(x[:, f])[int((len(x) - 1) * k / bins)] for k in range(1, bins)}) for f in range(x.shape[1])]
    raw = [math.log(y.mean() / (1 - y.mean()))] * len(y)
    for _ in range(trees):
        g = [t - 1 / (1 + math.exp(-r)) for t, r in zip(y, raw, strict=True)]
        h = [(1 / (1 + math.exp(-r))) * (1 - 1 / (1 + math.exp(-r))) for r in raw]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-6, None, None)
                score = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + ridge)  # noqa: E731, B023
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        left, right = [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]
                        if min(sum(h[i] for i in left), sum(h[i] for i in right)) >= least:
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] + 1e-12:
                                best = gain, f, c
                _, f, c = best
                below += [rows, []] if f is None else [[i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]]
            nodes = below
        for rows in nodes:
            for i in rows:
                raw[i] += rate * sum(g[j] for j in rows) / (sum(h[j] for j in rows) + ridge)
    return np.array(raw)


@pytest.mark.parametrize("seed", range(3))
def test_fit_equals_plain_boosting(seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(161, 3)), 2).astype(np.float32)
    y = ((x[:, 0] * x[:, 1] + 0.3 * r.normal(size=161)) > 0).astype(float)
    how = {"trees": 6, "depth": 3, "rate": 0.3, "bins": 8, "least": 1.0, "ridge": 1.0}
    want = plain_boosting(x.astype(float), y, **how)
    assert np.allclose(op.fit(x, y, **how).score(x), 1 / (1 + np.exp(-want)), atol=1e-5)


def test_query_equals_a_plain_version(spark, tmp_path):
    """The same statistics, boosted and walked plainly."""
    r = random.Random(2)
    good, bad = lambda k: prose(k, 60) + ".", lambda k: " ".join(r.choice(["BUY", "$$$", "now!!!", "9" * 9]) for _ in range(r.randrange(3, 40)))
    rows = [(k, (good if k % 3 else bad)(k)) for k in range(160)] + [(160, None), (161, ""), (None, "no id"), (3, "the same id")]
    labels = [(k, int(k % 3 > 0), 0) for k in range(120)] + [(5, 1, 0), (161, 0, 0), (7, None, 0), (999, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    stats = np.concatenate([op.statistics(b) for _, t in rows for b in blocks(pa.array([t], pa.string()))])
    told = sorted((d, q, stats[k].tobytes(), k) for d, q, _ in labels if q is not None and not held(d) for k, (e, _) in enumerate(rows) if e == d)
    x, y = stats[[t[3] for t in told]], np.array([t[1] for t in told], float)
    want = walk(op.fit(x, y), stats)
    got = sorted(((z.doc_id, round(z.score, 6), z.predicted, z.held_out) for z in op10_quality(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, round(p, 6), int(p >= op.THRESHOLD), held(d)) for (d, _), p in zip(rows, want.tolist(), strict=True)), key=str)


def test_one_class_or_none():
    x = np.zeros((4, 2), np.float32)
    assert op.fit(x[:0], np.zeros(0)).score(x).tolist() == [0.5] * 4
    assert (op.fit(x, np.ones(4)).score(x) > 0.8).all()


def test_statistics_do_not_depend_on_neighbours():
    texts = ["The cat. The CAT!", "", "a a a a\nb | c | d", "é" * 40, prose(1, 300)]
    alone = np.concatenate([op.statistics(b) for t in texts for b in blocks(pa.array([t]))])
    assert np.array_equal(alone, np.concatenate([op.statistics(b) for b in blocks(pa.array(texts))]))


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(docs_of, odd, spark, clashes):
    df = docs_of(odd, clashes)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (5, 1, 0), (7, None, None), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = op.learn(df, labels)
    rows = op.score(df, model).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert op.keep_good(df, model).columns == df.columns
    assert op.keep_good(df, model).count() == sum(r.predicted for r in rows)


def test_no_labels_and_no_rows(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in op.score(docs_of([(1, "x")]), op.learn(docs_of([]), labels)).collect()] == [0.5]
    assert op.score(docs_of([]), op.learn(docs_of([]), labels)).collect() == []


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TESTDATA}/labels.parquet").collect()}
    rows = [r for r in op10_quality(spark, TESTDATA).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9
    good = [r.predicted for r in rows if labels[r.doc_id] == 1]
    assert np.mean(good) > 0.97


def test_counts_do_not_depend_on_pieces():
    for b in blocks(pa.array(["ab C!", "", "é 9\n|", "x" * 50])):
        assert all((op._class_counts(b, n) == op._class_counts(b)).all() for n in (1, 3, 7))
