import math
import random
import re
from collections import Counter

import pytest

from plandag.llm import licenses as op
from plandag.llm.queries import op7_licenses
from tests.conftest import TESTDATA
from tests.llm.conftest import prose


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text):
    w = words(text)
    at = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in op.PHRASES}
    every = [k for ks in at.values() for k in ks]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(op.PHRASES[p] for p, ks in at.items() if ks))


CASES = [
    None, "", "CC BY", "cc-by cc by cc", "All rights  reserved. all RIGHTS reserved", "GNU General Public License, version 3", "general public licenses", "Éall rights reserved", "all rights\x7freserved", "ccé by", "x" * 70_000 + " all rights reserved",
    "Kelvin \u212a all rights reserved cc\u00a0by",
]


def test_base(docs_of):
    for r in op.scan(docs_of(list(enumerate(CASES)))).collect():
        assert tuple(r)[1:6] == brute(CASES[r.doc_id]), CASES[r.doc_id]


def test_notices(docs_of):
    filler = prose(5, 60)
    held = {k: f"{filler} {text} {filler}" for k, (_, text, _) in enumerate(op.NOTICES)}
    got = {r.doc_id: r for r in op.scan(docs_of([*held.items(), *((100 + k, prose(k, 50)) for k in range(40))])).collect()}
    for k, (label, *_) in enumerate(op.NOTICES):
        assert label in got[k].labels.split(",") and 0.7 <= got[k].score <= 1, label
        assert set(filter(None, got[k].base_labels.split(","))) <= set(got[k].labels.split(","))
    assert all(got[100 + k].labels == "" and got[100 + k].score == 0 for k in range(40))


def test_a_file_of_all_notices_has_all_labels(docs_of):
    texts = [text for _, text, _ in op.NOTICES]
    rows = [(1, f" {prose(1, 9)} ".join(texts)), (2, " ".join(reversed(texts))), *((3 + k, f"{prose(k, 20)} {text}") for k, text in enumerate(texts * 2))]
    got = {r.doc_id: set(r.labels.split(",")) for r in op.scan(docs_of(rows)).collect()}
    assert {label for label, *_ in op.NOTICES} <= got[1] & got[2]


def all_labels(texts):
    """(labels, score) of each text, by trying every box of every notice."""
    split = [words(t) for t in texts]
    df = Counter(w for ws in split for w in set(ws))
    weigh = lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 1
    out = []
    for ws, text in zip(split, texts, strict=True):
        labels, score = set(filter(None, brute(text)[4].split(","))), 1.0 if brute(text)[1] else 0.0
        found = []
        for label, notice, keys in op.NOTICES:
            own = [(w, k) for k, w in enumerate(words(notice)) if w not in op.FUNCTION_WORDS]
            boxes = {}
            for at, w in enumerate(ws):
                for x, place in own:
                    if x == w:
                        for shift in (0, op.SLACK // 2):
                            boxes.setdefault((shift, (at - place + shift) // op.SLACK), {})[place] = weigh(w)
            share = max((sum(b.values()) for b in boxes.values()), default=0) / sum(weigh(w) for w, _ in own)
            if share >= op.COVER - 1e-9 and all(f" {k} " in f" {' '.join(ws)} " for k in keys):
                labels.add(label)
                found.append(min(1.0, share))
        out.append((",".join(sorted(labels)), max(found, default=score)))
    return out


def test_query_equals_a_plain_version(spark, tmp_path):
    r = random.Random(6)

    def spoiled(notice):
        w = notice.split()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = r.choice([[], ["really"], ["the", "said"], ["license"]])
        return " ".join(w)

    texts = [None, "", *CASES[2:6]]
    for k in range(150):
        some = [spoiled(r.choice(op.NOTICES)[1]) for _ in range(r.randrange(4))]
        texts.append(" ".join([prose(k, r.randrange(30)), *(x for t in some for x in (t, prose(t, r.randrange(12))))]))
    texts.append(" ".join(f"{text} {prose(k, 700)}" for k, (_, text, _) in enumerate(op.NOTICES * 3)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = all_labels(texts)
    assert len({labels for labels, _ in want}) > 20 and any(0.7 < score < 1 for _, score in want)
    for x in op7_licenses(spark, str(tmp_path)).collect():
        assert (x.labels, pytest.approx(x.score, abs=1e-6)) == want[x.doc_id], texts[x.doc_id]


def test_words_put_in_do_not_split_a_notice(docs_of):
    texts = {k: t.split() for k, (_, t, _) in enumerate(op.NOTICES) if len(t.split()) > 12}
    rows = [(k, " ".join([*w[: len(w) // 2], "so", "to", "say", *w[len(w) // 2 :]])) for k, w in texts.items()]
    got = {r.doc_id: r.labels.split(",") for r in op.scan(docs_of([*rows, *((100 + k, prose(k, 50)) for k in range(30))])).collect()}
    assert all(op.NOTICES[k][0] in got[k] for k in texts)


def test_scattered_words_and_missing_key_phrases_are_no_notice(docs_of):
    scattered = f"apache {prose(1, 30)} licensed {prose(2, 30)} license {prose(3, 9)} version 0 2"
    rows = [(1, scattered), (2, "licensed under the apache permission license version 2 0"), *((k, prose(k, 50)) for k in range(3, 30))]
    got = {r.doc_id: r.labels for r in op.scan(docs_of(rows)).collect()}
    assert got[1] == got[2] == ""


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(docs_of, odd, clashes):
    rows = op.scan(docs_of(odd, clashes)).collect()
    assert sorted((r[0], *tuple(r)[1:6]) for r in rows if r[0] is not None) == sorted((d, *brute(t)) for d, t in odd if d is not None)
    assert len(rows) == len(odd) and op.scan(docs_of([])).collect() == []


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    rows = op7_licenses(spark, TESTDATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == brute(texts[r.doc_id])
        for notice, label in (("Apache License, Version 2.0", "apache-2.0"), ("the MIT License", "mit"), ("BY-NC 4.0", "cc-by-nc-4.0"), ("License, version 3", "gpl-3.0")):
            assert (notice in texts[r.doc_id]) == (label in r.labels.split(","))


def test_plan_is_native(spark):
    plan = op7_licenses(spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
