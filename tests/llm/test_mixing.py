import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plandag.llm import mixing as op
from plandag.llm.queries import op6_mixing
from tests.conftest import TESTDATA
from tests.llm.conftest import prose


def test_raking_meets_the_marginals():
    r = np.random.default_rng(2)
    w = r.random((5, 3, 4)) * (r.random((5, 3, 4)) > 0.2)
    targets = [x / x.sum() for x in (r.random(n) + 0.1 for n in w.shape)]
    fitted = op.rake(w, targets)
    for a, t in enumerate(targets):
        assert np.allclose(fitted.sum(axis=tuple(b for b in range(3) if b != a)), t, atol=1e-8)
    assert ((fitted > 0) == (w > 0)).all()
    ratio = np.log(fitted[w > 0] / w[w > 0])  # a factor of each level, no interactions
    design = np.array([[*np.eye(5)[a], *np.eye(3)[b], *np.eye(4)[c]] for a, b, c in np.argwhere(w > 0)])
    assert np.abs(design @ np.linalg.lstsq(design, ratio, rcond=None)[0] - ratio).max() < 1e-6


def test_scale_keeps_the_share():
    tokens, factor = np.array([10.0, 20, 70]), np.array([5.0, 0.1, 1])
    s = op.scale(tokens, factor, 0.6)
    assert (tokens * np.minimum(1, s * factor)).sum() == pytest.approx(60)
    assert (tokens * np.minimum(1, op.scale(tokens, factor, 1.0) * factor)).sum() == pytest.approx(100)


KINDS_OF_TEXT = {"prose": lambda r: " ".join(r.choice(["the", "little", "river", "walked"]) for _ in range(60)), "numbers": lambda r: " ".join(str(r.randrange(10**6)) for _ in range(60)), "code": lambda r: "\n".join(f"x{r.randrange(9)} = f(y[{r.randrange(9)}]);" for _ in range(30))}


def test_topics_are_kinds_of_text():
    r = random.Random(1)
    kinds = [k for k in KINDS_OF_TEXT for _ in range(20)]
    texts = [KINDS_OF_TEXT[k](r) for k in kinds]
    _, x = op.features(pa.array(texts))
    topics = op.Topics.fit(x, 3)
    n, own = topics.of(pa.array([*texts, "", None, "!?"]))
    assert n[-3:].tolist() == [0, 0, 0] and own[-3:] == ["none"] * 3
    assert len(set(zip(kinds, own, strict=False))) == len(set(own[:-3])) == 3
    z = (x - topics.mean) / topics.spread
    for row, c in zip(z, topics.nearest(z), strict=True):  # the nearest center, plainly
        assert c == min(range(3), key=lambda k: (sum((a - b) ** 2 for a, b in zip(row, topics.centers[k], strict=True)), k))
    for c in range(3):  # each in the middle of its own
        assert np.allclose(topics.centers[c], z[topics.nearest(z) == c].mean(axis=0))
    assert [topics.of(pa.array([t]))[1][0] for t in texts] == own[:-3]
    assert op.Topics.fit(x[:0]).of(pa.array(["a b"]))[1] == ["none"] and op.Topics.fit(x[:1]).of(pa.array(["a b"]))[1] == ["topic0"]


def plain_means(texts, k):
    """k-means over all texts with words, until no text changes its center: the number of texts of each, largest first, and the text's."""
    n, x = op.features(pa.array(texts))
    x = x[n > 0].astype(float)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    far = lambda: np.min([((z - c) ** 2).sum(axis=1) for c in centers], axis=0)
    centers = [z[(z**2).sum(axis=1).argmin()]]
    while len(centers) < k and far().max() > 1e-12:
        centers.append(z[far().argmax()])
    own = None
    while own is None or (own != new).any():
        own = np.argmin([((z - c) ** 2).sum(axis=1) for c in centers], axis=0) if own is None else new
        centers = [z[own == c].mean(axis=0) for c in range(len(centers))]
        new = np.argmin([((z - c) ** 2).sum(axis=1) for c in centers], axis=0)
    size = np.bincount(own, minlength=len(centers))
    place = np.argsort(np.argsort(-size, kind="stable"))
    told = iter(place[own])
    return [f"topic{next(told)}" if w else "none" for w in n]


def many_kinds(rows=12_000):
    """More documents than a sample would hold, of kinds that run into one another, and a few that stand apart."""
    r = random.Random(8)
    kinds = [*KINDS_OF_TEXT.values()]
    texts = [r.choice(kinds)(r)[: r.randrange(5, 400)] + "." * r.randrange(9) for _ in range(rows)]
    return [*texts, *(("|" * (20 + k) + " a ") * 9 for k in range(3)), "", "!?"]


def test_topics_come_from_all_documents(docs_of):
    texts = many_kinds()
    df = docs_of(list(enumerate(texts)))
    want = plain_means(texts, op.TOPICS)
    for parts in (1, 7):  # however they are dealt out
        got = {r.doc_id: r.topic for r in op.report(df.repartition(parts)).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_sums_of_features_are_exact():
    x = np.tile(np.array([[1 << 21] * op.WIDTH, [(1 << 21) - 1] * op.WIDTH]), (40_000, 1))
    n, *sums = op.moments(x)[0].tolist()
    assert (n, sums[0]) == (80_000, 40_000 * ((1 << 22) - 1))
    assert (sums[op.WIDTH] << 21) + sums[2 * op.WIDTH] == 40_000 * ((1 << 42) + ((1 << 21) - 1) ** 2)


def test_targets_that_cannot_be_met():
    weights = np.array([[1.0, 0], [0, 1]])
    with pytest.raises(ValueError, match="off by"):
        op.rake(weights, [np.array([0.1, 0.9]), np.array([0.9, 0.1])])
    with pytest.raises(ValueError, match="off by"):
        op.probabilities([("=a", "=x", "t", 1), ("=b", "=y", "t", 1)], {"source": {"a": 0.1, "b": 0.9}, "lang": {"x": 0.9, "y": 0.1}}, 0.7, 0.5)
    with pytest.warns(UserWarning, match="off by"):
        op.probabilities([("=a", "=x", "t", 1), ("=b", "=x", "t", 1), ("=c", "=y", "t", 2)], None, 0.7, 0.5)


def test_topics_of_a_column(docs_of):
    df = docs_of([(k, prose(k, 9), "en", f"s{k % 2}", 0) for k in range(200)]).selectExpr("*", "if(doc_id % 5 = 0, null, concat('t', doc_id % 3)) as subject")
    rows = op.report(df, topic="subject", targets={"topic": {"t0": 0.5, "null": 0.2}}).collect()
    assert all(r.topic == ("null" if r.doc_id % 5 == 0 else f"t{r.doc_id % 3}") for r in rows)
    aim = Counter()
    for r in rows:
        aim[r.topic] += r.n_tokens * r.probability * r.weight
    assert aim["t0"] / sum(aim.values()) == pytest.approx(0.5, abs=1e-6)


def plain_raking(cells, temper=op.TEMPER, keep=op.KEEP_SHARE):
    """cells: tokens by (source, language, topic). Probability and weight of each."""
    total = sum(cells.values())
    fitted = {k: n / total for k, n in cells.items() if n}
    for _ in range(3000):
        for d in range(3):
            own, have = Counter(), Counter()
            for k, n in cells.items():
                own[k[d]] += n
            wanted = {x: n**temper for x, n in own.items() if n}
            for k, x in fitted.items():
                have[k[d]] += x
            fitted = {k: x * wanted[k[d]] / sum(wanted.values()) / have[k[d]] for k, x in fitted.items()}
    factor = {k: x * total / cells[k] for k, x in fitted.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(cells[k] * min(1, mid * f) for k, f in factor.items()) < keep * total else (low, mid)
    return {k: (min(1.0, high * factor[k]), max(1.0, high * factor[k])) if k in factor else (1.0, 1.0) for k in cells}


def test_query_equals_a_plain_version(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.choice([*KINDS_OF_TEXT.values()])(r)[: r.randrange(20, 300)], r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "b", "c", None])) for k in range(900)]
    rows += [(900, None, "en", "a"), (901, "", "empty", "a"), (902, "x " * 40_000, "en", "b"), (None, "no id", "en", "a"), (5, "same id", "fr", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_mixing(spark, str(tmp_path)).collect()
    texts = Counter((d, s, lang, len(re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", t or ""))) for d, t, lang, s in rows)
    assert texts == Counter((x.doc_id, x.source, x.lang, x.n_tokens) for x in got)
    cells = Counter()
    for x in got:
        cells[x.source, x.lang, x.topic] += x.n_tokens
    want = plain_raking(cells)
    assert len({x.topic for x in got}) > 3
    for x in got:
        assert (x.probability, x.weight) == pytest.approx(want[x.source, x.lang, x.topic], abs=1e-5)
    kept = sum(x.n_tokens * x.weight for x in got if x.sampled and x.doc_id != 902) / sum(x.n_tokens * x.probability * x.weight for x in got if x.doc_id != 902)
    assert kept == pytest.approx(1, abs=0.15)


def test_given_targets(docs_of):
    rows = [(k, prose(k, 50), "en" if k % 3 else "fr", f"s{k % 4}", 0) for k in range(4000)]
    out = op.report(docs_of(rows), targets={"source": {"s0": 0.7, "s1": 0.2}, "lang": {"fr": 0.5, "en": 0.5}}, keep_share=0.2).collect()
    assert len(out) == 4000
    tokens = Counter()
    for r in out:
        for k in (r.source, r.lang):
            tokens[k] += r.n_tokens * r.probability * r.weight
    whole = tokens["en"] + tokens["fr"]
    assert tokens["s0"] / whole == pytest.approx(0.7, abs=1e-6) and tokens["s1"] / whole == pytest.approx(0.2, abs=1e-6) and tokens["fr"] / whole == pytest.approx(0.5, abs=1e-6)
    kept = sum(r.n_tokens for r in out if r.sampled)
    assert kept / sum(r.n_tokens for r in out) == pytest.approx(0.2, abs=0.02)
    with pytest.raises(ValueError):
        op.report(docs_of(rows[:3]), targets={"lang": {"xx": 1.0}})


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(docs_of, odd, clashes):
    more = [(20, "null level", None, None, 3), (21, "other level text", "fr", "s9", 3)]
    df = docs_of([*odd, *more], clashes)
    rows = op.report(df).collect()
    assert len(rows) == len(odd) + 2 and all(0 <= r.probability <= 1 and r.weight >= 1 - 1e-9 for r in rows)
    kept = op.sample(df)
    assert kept.count() == sum(r.sampled for r in rows)
    assert set(df.columns) - {"sampled"} <= set(kept.columns) and len(kept.columns) == len(set(kept.columns))
    assert len({r.sampled for r in rows if r.doc_id == 5}) == 1


def test_empty(docs_of):
    assert op.report(docs_of([])).collect() == []
    assert [r.sampled for r in op.report(docs_of([(1, None), (2, "!")])).collect()] == [True, True]


def test_pooled_levels(docs_of):
    rows = [(k, prose(k, 20), "en", f"s{k % 10}", 0) for k in range(100)]
    assert {r.source for r in op.report(docs_of(rows), levels=2).collect()} == {f"s{k}" for k in range(10)}


def test_many_sources_are_levels_of_their_own(docs_of):
    rows = [(k, prose(k, 20), "en", f"s{k % 150}", 0) for k in range(1500)] + [(k, prose(k, 20), "en", "large", 0) for k in range(1500, 1800)]
    own, aim = Counter(), Counter()
    for r in op.report(docs_of(rows)).collect():
        own[r.source] += r.n_tokens
        aim[r.source] += r.n_tokens * r.probability * r.weight
    wanted = {k: v**op.TEMPER for k, v in own.items()}
    assert len(own) == 151
    for k in own:
        assert aim[k] / sum(aim.values()) == pytest.approx(wanted[k] / sum(wanted.values()), abs=1e-6)


@pytest.mark.parametrize("targets", [None, {"source": {"s0": 0.5, "other": 0.3, "null": 0.2}, "lang": {"fr": 0.6}}])
def test_tables_of_cells_give_what_the_driver_gives(docs_of, monkeypatch, targets):
    sources = [*(f"s{k}" for k in range(8)), None, "null", "other"]
    rows = [*((k, prose(k, 30), "en" if k % 3 else "fr", sources[k % 11 if k % 4 else 0], 0) for k in range(600)), (600, "", "xx", "empty", 0)]
    read = lambda: {r.doc_id: r for r in op.report(docs_of(rows), targets=targets).collect()}
    one = read()
    monkeypatch.setattr(op, "DRIVER_CELLS", 0)
    two = read()
    assert one.keys() == two.keys() == set(range(601))
    for k, r in one.items():
        assert (r.source, r.lang, r.topic, r.n_tokens) == (two[k].source, two[k].lang, two[k].topic, two[k].n_tokens)
        assert r.probability == pytest.approx(two[k].probability, abs=1e-8) and r.weight == pytest.approx(two[k].weight, abs=1e-7)
    if targets:
        kept = {s: sum(r.n_tokens * r.probability * r.weight for r in two.values() if s == (r.source if r.source in ("s0", None) else "rest")) for s in ("s0", None, "rest")}
        assert [kept[s] / sum(kept.values()) for s in ("s0", None, "rest")] == pytest.approx([0.5, 0.2, 0.3], abs=1e-6)


def test_query(spark):
    rows = op6_mixing(spark, TESTDATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    own, aim = Counter(), Counter()
    for r in rows:
        assert r.n_tokens == len(re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", docs[r.doc_id].text))
        own[r.lang] += r.n_tokens
        aim[r.lang] += r.n_tokens * r.probability * r.weight
    wanted = {k: v**op.TEMPER for k, v in own.items()}
    for k in own:
        assert aim[k] / sum(aim.values()) == pytest.approx(wanted[k] / sum(wanted.values()), abs=1e-6)
