import pytest

import corpus_pipeline as pipeline
from plandag.llm import decontamination, exact_dedup, mixing, near_duplicates, quality
from tests.conftest import TESTDATA
from tests.llm.test_exact_dedup import norm
from tests.llm.test_mixing import many_kinds, plain_means
from tests.llm.test_near_duplicates import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, TESTDATA), "test")
        out.append((name, docs.collect()))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"]
    for _, rows in stages[1:-1]:
        assert list(rows[0].asDict()) == list(stages[0][1][0].asDict())
    assert [len(r) for _, r in stages] == sorted((len(r) for _, r in stages), reverse=True)


def test_each_stage_does_its_work(stages, spark):
    docs, good, distinct, near, clean, mixed = (rows for _, rows in stages)
    df = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.score(df, quality.learn(df, spark.read.parquet(f"{TESTDATA}/labels.parquet"))).collect()}
    assert {r.doc_id for r in good} == {r.doc_id for r in docs if scores[r.doc_id]}
    least = {}
    for r in good:
        least[norm(r.text)] = min(least.get(norm(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in distinct) == sorted(least.values())
    assert {r.doc_id for r in near} == {c for _, c, *_ in brute([(r.doc_id, r.text) for r in distinct])}
    frame = spark.createDataFrame(near, df.schema)
    leaks = {r.doc_id for r in decontamination.report(frame, spark.read.parquet(f"{TESTDATA}/benchmark.parquet")).collect()}
    assert leaks and {r.doc_id for r in clean} == {r.doc_id for r in near} - leaks
    chosen = {r.doc_id for r in mixing.report(spark.createDataFrame(clean, df.schema)).collect() if r.sampled}
    assert {r.doc_id for r in mixed} == chosen
    assert all(r.text == s.text for r in mixed for s in [next(x for x in docs if x.doc_id == r.doc_id)])


def test_run_is_the_stages(stages, spark):
    assert sorted(r.doc_id for r in pipeline.run(spark, TESTDATA).collect()) == sorted(r.doc_id for r in stages[-1][1])


def test_topics_of_the_mix_come_from_all_documents(docs_of, spark):
    texts = many_kinds()
    docs = docs_of(list(enumerate(texts)))
    want = plain_means(texts, mixing.TOPICS)
    mixed = dict(pipeline.STAGES)["mixing"](spark, docs, TESTDATA).collect()
    assert len(mixed) > 1000 and all(r.topic == want[r.doc_id] for r in mixed)


@pytest.mark.parametrize("step", [exact_dedup.drop_copies, near_duplicates.keep_one, mixing.sample])
def test_empty(docs_of, step):
    assert step(docs_of([])).collect() == []


def test_tables_are_released(spark):
    from plandag.llm.shared import materialize, release

    one, two = materialize(spark.range(5), "one"), materialize(spark.range(7), "two")
    release(spark, two)
    assert two.count() == 7
    with pytest.raises(Exception, match=one.inputFiles()[0].rpartition("/")[2]):
        one.collect()
    release(spark)
    release(spark)
