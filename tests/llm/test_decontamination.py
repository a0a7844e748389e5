import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plandag.llm import decontamination as op
from plandag.llm.queries import op9_decontamination
from tests.conftest import TESTDATA
from tests.llm.conftest import prose


def words(t):
    return re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (t or "").lower())


def plain_tiling(doc, item, n=op.SEED):
    """Greedy string tiling as published: all pairs of places, longest matches first."""
    fd, fi, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best, found = n - 1, []
        for a in range(len(doc)):
            for b in range(len(item)):
                k = 0
                while a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k] and fd[a + k] and fi[b + k]:
                    k += 1
                if k > best:
                    best, found = k, [(a, b)]
                elif k == best and k >= n:
                    found.append((a, b))
        if not found:
            return covered
        for a, b in found:
            if all(fd[a : a + best]) and all(fi[b : b + best]):
                fd[a : a + best] = [False] * best
                fi[b : b + best] = [False] * best
                covered += best


@pytest.mark.parametrize("seed", range(8))
def test_tiles_cover_what_plain_tiling_covers(seed):
    r = random.Random(seed)
    item = [r.randrange(30 if seed % 2 else 4) for _ in range(40)]
    doc = []
    for _ in range(6):
        a = r.randrange(40)
        doc += [*item[a : a + r.randrange(12)], *(r.randrange(4) for _ in range(r.randrange(4)))]
    tiles = op.tile(np.array(doc, np.uint64), np.array(item, np.uint64))
    assert sum(t[2] for t in tiles) == plain_tiling(doc, item) or seed % 2 == 0  # ties may be taken in another order
    for a, b, k in tiles:
        assert k >= op.SEED and doc[a : a + k] == item[b : b + k]
    assert len({x for a, _, k in tiles for x in range(a, a + k)}) == len({x for _, b, k in tiles for x in range(b, b + k)}) == sum(t[2] for t in tiles)


REPETITIVE = [" ".join((prose(f"line{n}", n).split() * 100)[:size]) for n, size in ((12, 100), (8, 80), (4, 40), (1, 40), (5, 4000))]


@pytest.mark.parametrize("block_chars", [op.BLOCK_CHARS, 300])
def test_copies_of_repetitive_items(docs_of, spark, block_chars):
    items = spark.createDataFrame(list(enumerate(REPETITIVE)), "item_id long, text string")
    docs = docs_of([*((k, f"{prose(k, 30)} {text} {prose(-k, 30)}") for k, text in enumerate(REPETITIVE)), (9, prose(9, 300)), (10, " ".join(REPETITIVE[0].split()[:45]))])
    assert {(r.doc_id, r.item_id, r.coverage) for r in op.report(docs, items, block_chars=block_chars).collect()} == {(k, k, 1.0) for k in range(len(REPETITIVE))}
    assert sorted(r.doc_id for r in op.drop_contaminated(docs, items, block_chars=block_chars).collect()) == [9, 10]


@pytest.mark.parametrize("places", [1 << 20, 7])
def test_the_screen_loses_no_pair(monkeypatch, places):
    monkeypatch.setattr(op, "PLACES", places, raising=False)
    r = random.Random(1)
    text = lambda words, n: " ".join(f"w{r.randrange(words)}" for _ in range(n))
    texts = [text(r.choice((1, 2, 3, 9)), r.randrange(4, 60)) for _ in range(40)]
    docs = [*texts, *(" ".join([texts[k], text(3, 20), texts[-k]]) for k in range(40))]
    items = op.Items.build(list(range(40)), texts, op.COVER)
    got = {(d, i): sum(t[2] for t in tiles) for d, i, tiles in op.leaks(pa.array(docs), items)}
    hashes = op.Items.build(list(range(80)), docs, op.COVER).hashes
    covered = {(d, i): sum(t[2] for t in op.tile(hashes[d], h)) for d in range(80) for i, h in enumerate(items.hashes)}
    assert got == {(d, i): n for (d, i), n in covered.items() if n >= op.COVER * len(items.hashes[i])}


@pytest.fixture(scope="module")
def bench(spark):
    items = [(k, prose(f"item{k}", 40)) for k in range(12)]
    rows = [*items, (12, None), (13, ""), (14, "two words"), (15, items[0][1]), (None, prose("no id", 30))]
    return dict(items), spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_chars", [op.BLOCK_CHARS, 300])
def test_planted(docs_of, bench, block_chars):
    items, df = bench
    w = items[3].split()
    rows = {
        1: f"{prose(1, 50)} {items[1].upper()} {prose(2, 50)}", 2: " ".join(w[20:] + prose(3, 10).split() + w[:20]), 3: " ".join(items[4].split()[:12]), 4: prose(9, 500),
        5: " ".join(x for k, x in enumerate(items[5].split()) if k % 7), 6: items[0], 7: items[6] + " " + items[7], 8: prose("no id", 30),
    }
    got = sorted(((r.doc_id, r.item_id) for r in op.report(docs_of(list(rows.items())), df, block_chars=block_chars).collect()), key=str)
    assert got == sorted([(1, 1), (2, 3), (5, 5), (6, 0), (6, 15), (7, 6), (7, 7), (8, None)], key=str)
    kept = op.drop_contaminated(docs_of(list(rows.items()), True), df, block_chars=block_chars)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4] and kept.columns == docs_of([], True).columns


def test_items_of_a_few_words(docs_of, spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "the answer"), (3, "yes yes yes"), (4, "!?"), (5, "a b c d")], "item_id long, text string")
    texts = ["in paris, once", "the the answer", "answer the", "yes yes no yes", "no yes YES yes", "a b c", "x a b c d", "parisian"]
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in op.report(docs_of(list(enumerate(texts))), items).collect())
    assert got == [(0, 1, 1.0), (1, 2, 1.0), (4, 3, 1.0), (6, 5, 1.0)]


def test_repetitive_texts_take_bounded_memory():
    import tracemalloc

    doc, item = np.ones(20_000, np.uint64), np.ones(2_000, np.uint64)
    tracemalloc.start()
    assert sum(t[2] for t in op.tile(doc, item)) == 2_000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_query_on_repetitive_and_long_documents(spark, tmp_path):
    """Every pair is tiled plainly; no screen."""
    r = random.Random(5)
    items = [*REPETITIVE[:4], *(prose(f"q{k}", r.randrange(3, 30)) for k in range(8)), "yes no", None, ""]
    texts = [" ".join([prose(k, r.randrange(40)), r.choice(items) or "", prose(-k, r.randrange(40)), " ".join((r.choice(items) or "").split()[: r.randrange(1, 60)])]) for k in range(40)]
    texts += [f"{prose('long', 4000)} {items[5]} {prose('more', 1500)}", "yes " * 3500, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x.doc_id, x.item_id): x.coverage for x in op9_decontamination(spark, str(tmp_path)).collect()}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            w, v = words(item), words(text)
            if not w or len(w) * len(v) > 300_000:
                continue
            covered = plain_tiling(v, w, min(op.SEED, len(w))) / len(w)
            # Of equally long tiles, one choice may leave room for more than another.
            assert ((d, i) in got) == (covered >= op.COVER) or len(set(w)) < len(w), (d, i)
            if len(set(w)) == len(w):
                assert got.get((d, i), covered) == pytest.approx(covered)
    assert (40, 5) in got


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(docs_of, odd, bench, spark, clashes):
    df = docs_of(odd, clashes)
    assert op.report(df, bench[1]).collect() == [] and op.drop_contaminated(df, bench[1]).count() == len(odd)
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.report(df, none).collect() == [] and op.drop_contaminated(df, none).count() == len(odd)
    assert op.report(docs_of([]), bench[1]).collect() == []


def test_query_equals_plain_tiling(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()}
    seeds = {i: {tuple(w[k : k + op.SEED]) for k in range(len(w) - op.SEED + 1)} for i, w in items.items()}
    got = {(r.doc_id, r.item_id): r.coverage for r in op9_decontamination(spark, TESTDATA).collect()}
    assert got
    for d, w in docs.items():
        own = {tuple(w[k : k + op.SEED]) for k in range(len(w) - op.SEED + 1)}
        for i, s in seeds.items():
            if len(own & s) >= op.COVER * len(items[i]) / op.SEED and len(w) < 3000:
                covered = plain_tiling(w, items[i]) / len(items[i])
                assert got.pop((d, i), 0.0) == pytest.approx(covered) if covered >= op.COVER else (d, i) not in got
    assert all(len(docs[d]) >= 3000 for d, _ in got)
