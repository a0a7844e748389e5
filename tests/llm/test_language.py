import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plandag.llm import language as op
from plandag.llm.queries import op1_language
from tests.conftest import TESTDATA

TEXTS = [(1, "the cat and the dog are on the mat", "en"), (2, "the house and the garden of the king", "en"), (3, "der hund und die katze sind auf der matte", "de"), (4, "das haus und der garten des königs", "de"), (5, None, "de"), (6, "nothing known", None)]


def runs(text):
    out, word = [], ""
    for ch in (text or "").lower() + " ":
        word, done = (word + ch, "") if ch.isalpha() else ("", word)
        if done:
            out.append(done)
    return out


def marked(word, n):
    text = f"\x01{word}\x01"
    return [word[k] for k in range(len(word))] if n == 1 else [text[k : k + n] for k in range(len(text) - n + 1)]


def brute(rows, texts):
    """(language, score) of each text; rows: (text, lang) to learn from, all of them."""
    langs = sorted({lang for _, lang in rows})
    seen = [{lang: Counter() for lang in langs} for _ in range(op.LONGEST + 1)]
    for text, lang in rows:
        for w in runs(text):
            seen[0][lang][w] += 1
            for n in range(1, op.LONGEST + 1):
                seen[n][lang].update(marked(w, n))
    whole = [{lang: sum(c.values()) for lang, c in level.items()} for level in seen]

    def logs(n, x):
        least = 0.5 / max(1, *whole[n].values())
        return [math.log(seen[n][lang][x] / max(1, whole[n][lang]) + least) for lang in langs] if any(c[x] for c in seen[n].values()) else None

    def score(word):
        if told := logs(0, word):
            return told
        for n in range(op.LONGEST, 0, -1):
            if known := [x for g in marked(word, n) if (x := logs(n, g))]:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return None

    out = []
    for text in texts:
        words = runs(text)
        if not words:
            out.append(("und", 0.0))
            continue
        told = [x for w in words if (x := score(w))]
        mean = [sum(x) / max(1, len(told)) * min(max(1, len(told)), op.WORDS) for x in zip(*told, strict=True)] if told else [0.0] * len(langs)
        best = max(range(len(langs)), key=lambda k: (mean[k], -k))
        out.append((langs[best], 1 / sum(math.exp(x - mean[best]) for x in mean)))
    return out


def test_query_equals_a_plain_version(spark, tmp_path):
    r = random.Random(8)
    syllables = {"aa": "ba ta ka lo", "bb": "ba éu zi na", "cc": "ki po ж ло", "dd": "ta na q x"}
    word = lambda lang: "".join(r.choice(syllables[lang].split()) for _ in range(r.randrange(1, 5)))
    rows = []
    for k in range(300):
        lang = r.choice([*syllables, None])
        rows.append((k, r.choice([None, "", "12 !", " ".join(word(lang or r.choice([*syllables])) for _ in range(r.randrange(1, 30))) + ". X1y"]) if k % 3 else " ".join(word(lang or "aa") for _ in range(9)), lang))
    rows += [(None, "ba ta ka", "aa"), (300, "ßtraße İi", None), (301, "b" * 3000, "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    want = brute([(t, lang) for d, t, lang in rows if d is not None and not held(d) and t is not None and lang], [t for _, t, _ in rows])
    got = {x.doc_id: x for x in op1_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and len({lang for lang, _ in want}) == 5
    for (d, *_), (lang, score) in zip(rows, want, strict=True):
        assert (got[d].lang_pred, got[d].held_out) == (lang, held(d)) and got[d].score == pytest.approx(score, abs=1e-5)


def test_words_seen_once_are_known(docs_of):
    model = op.learn(docs_of([(1, "once twice twice", "x"), (2, "other", "y")]), F.lit(True))
    assert len(model.levels[0].hashes) == 3 and model.levels[0].look_up(op.split(["once"]).hashes)[0] >= 0


def test_many_languages_keep_their_words(docs_of):
    rows = [(k, f"w{chr(97 + k // 26)}{chr(97 + k % 26)}q common", f"l{k:03}") for k in range(300)]
    model = op.learn(docs_of(rows), F.lit(True))
    assert len(model.levels[0].hashes) == 301 and len(model.levels[0].language) == 600
    assert model.predict([t for _, t, _ in rows])[0] == [lang for *_, lang in rows]


def test_known_words_and_backoff(docs_of):
    model = op.learn(docs_of(TEXTS), F.lit(True))
    assert model.languages == ["de", "en"]
    got, score = model.predict(["the and of", "der und", "katzenhaus königsgarten", "THE DOG", "", "123 !?", "ж", "the " * 5000])
    assert got == ["en", "de", "de", "en", "und", "und", "de", "en"]  # a letter that nothing knows: the first language
    assert score[4] == score[5] == 0 and ((score >= 0) & (score <= 1)).all()


def test_unseen_words_use_the_longest_known_grams(docs_of):
    model = op.learn(docs_of([(1, "abcd abcd", "x"), (2, "bcda bcda", "y")]), F.lit(True))
    found = op.split(["abcd abce zzzz"])
    scores, told = model.word_scores(found)
    by = {"".join(map(chr, found.chars[s : s + n])): (scores[k], told[k]) for k, (s, n) in enumerate(zip(found.start, found.length, strict=True))}
    assert by["abcd"][0][0] > by["abcd"][0][1] and by["abce"][0][0] > by["abce"][0][1] and not by["zzzz"][1]


def test_batches_do_not_matter(docs_of):
    model = op.learn(docs_of(TEXTS), F.lit(True))
    texts = [t for _, t, _ in TEXTS if t] * 3
    whole = model.predict(texts)
    assert whole[0] == [model.predict([t])[0][0] for t in texts]


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(docs_of, odd, clashes):
    df = docs_of(odd, clashes)
    rows = op.identify(df, op.learn(df, op.outside_fold(F.col("doc_id")))).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert r.lang_pred in ("en", "und")
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)} == {"und"}


def test_nothing_to_learn_from(docs_of):
    model = op.learn(docs_of([]), F.lit(True))
    assert [(r.lang_pred, r.score) for r in op.identify(docs_of([(1, "words")]), model).collect()] == [("und", 0.0)]
    assert op.identify(docs_of([]), model).collect() == []


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    rows = [r for r in op1_language(spark, TESTDATA).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) / len(rows) > 0.98


@pytest.mark.parametrize("size", [1, 7, 40, 10**6])
def test_pieces_do_not_matter(docs_of, size):
    model = op.learn(docs_of(TEXTS), F.lit(True))
    texts = ["der hund the cat " * 9, "", "x", "katzenhausgartenmatte" * 5 + " und", None, "!!! 1"]
    assert ["".join(op.pieces(t, size)) for t in texts if t] == [t for t in texts if t]
    want, got = model.predict(texts), model.predict(texts, size)
    assert want[0] == got[0] and want[1] == pytest.approx(got[1])
