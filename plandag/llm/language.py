"""Language identification: words first, then ever shorter character n-grams.

A known word scores the log of its share of the words of each language. An unseen word scores by its n-grams (with a mark at either end)
of the greatest length of which the model knows any, down to single characters; a word none of whose characters is known says nothing.
A text's score is the posterior of the best language when the mean of its words' scores counts as WORDS words of evidence.

Learned from documents with a language outside the held-out fold: at most about PER_LANGUAGE of each language and SAMPLE in all, chosen by a hash
of the id. All their words and n-grams are known, those seen once too; the sample alone bounds the model. It is held sparsely, an entry for each
language that has a word or n-gram, so its size doesn't grow with their product. Texts are lower-cased; words are runs of letters.

Null and empty texts, and such without a letter, are "und" with score 0, and so is every text if nothing could be learned (no documents, say).
Long texts are read whole, in pieces cut between words. Equal scores go to the language that sorts first. Rows that repeat an id or a text are
judged one by one. Columns besides doc_id, text and lang are left aside, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plandag.llm.quality import fold
from plandag.llm.textkit import BASE, U, mix, prefix_hash, span_hash

PER_LANGUAGE, SAMPLE, LONGEST, WORDS = 4000, 64_000, 5, 8
#: Code points worked on at once (longer texts are cut between words), and scores of all languages.
CHARS, SCORES = 1 << 18, 1 << 24
MARK = 1

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


@dataclass
class Words:
    """Distinct words of some texts: hash, row of each occurrence, index of its word, and each word's characters."""

    hashes: np.ndarray
    word: np.ndarray
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    chars: np.ndarray


def split(texts: list[str]) -> Words:
    # Lower-cased one by one: what a letter becomes at the end of a word may depend on what follows. A line feed keeps texts apart.
    low = [t.lower() for t in texts]
    chars = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters()[chars]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    every = mix(span_hash(prefix_hash(chars), start, end))
    hashes, first, word = np.unique(every, return_index=True, return_inverse=True)
    return Words(hashes, word, np.searchsorted(ends, start, side="right"), start[first], (end - start)[first], chars)


def ngrams(found: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the chosen words, and the position of each one's word in which."""
    length = found.length[which] + 2
    total = int(length.sum())
    owner = np.repeat(np.arange(len(which)), length)
    within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    inner = (within > 0) & (within < length[owner] - 1)
    text = np.full(total, MARK, U)
    text[inner] = found.chars[(found.start[which][owner] + within - 1)[inner]]
    at = np.flatnonzero(within <= length[owner] - n)
    if n == 1:
        at = at[inner[at]]
    value = np.zeros(len(at), U)
    for k in range(n):
        value = value * BASE + text[at + k] + U(1)
    return mix(value + U(n)), owner[at]


def pieces(text: str, size: int) -> Iterator[str]:
    """The text, cut before characters that are no letters."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def blocks(texts: pa.Array, size: int = CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts with the rows they come from, so many characters at once."""
    rows, own, held = [], [], 0
    for k, text in enumerate(texts.to_pylist()):
        for piece in pieces(text or "", size):
            if own and held + len(piece) > size:
                yield rows, own
                rows, own, held = [], [], 0
            rows.append(k)
            own.append(piece)
            held += len(piece)
    if own:
        yield rows, own


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, hash, count) of words (n = 0) and n-grams, summed up for each language of a batch."""
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(text or "")
        for lang, texts in sorted(by.items()):
            for _, own in blocks(pa.array(texts)):
                found = split(own)
                times = np.bincount(found.word, minlength=len(found.hashes))
                out = [(0, found.hashes, times)]
                for n in range(1, LONGEST + 1):
                    h, owner = ngrams(found, np.arange(len(found.hashes)), n)
                    h, back = np.unique(h, return_inverse=True)
                    out.append((n, h, np.bincount(back, times[owner], len(h)).astype(np.int64)))
                for n, h, t in out:
                    columns = [pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(t.astype(np.int64))]
                    yield pa.record_batch(columns, ["lang", "n", "hash", "count"])


@dataclass
class Level:
    """Words, or n-grams of one length: sorted hashes, the languages of each (from bounds[k] to bounds[k + 1]), and what its log share there is above
    the floor, the log share of what a language doesn't have."""

    hashes: np.ndarray
    bounds: np.ndarray
    language: np.ndarray
    above: np.ndarray
    floor: float

    @classmethod
    def build(cls, hashes: np.ndarray, language: np.ndarray, count: np.ndarray, languages: int) -> Level:
        order = np.lexsort((language, hashes))
        hashes, language, count = hashes[order], language[order], count[order]
        whole = np.maximum(np.bincount(language, count, languages), 1)
        least = 0.5 / whole.max()  # one floor for all languages: else what is unseen speaks for the smallest of them
        known, first = np.unique(hashes, return_index=True)
        above = np.log(count / whole[language] + least) - np.log(least)
        return cls(known, np.append(first, len(hashes)), language.astype(np.int32), above.astype(np.float32), float(np.log(least)))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if it is unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def sums(self, at: np.ndarray, row: np.ndarray, rows: int, languages: int) -> np.ndarray:
        """For each row and language, the sum of what the entries are above the floor."""
        times = self.bounds[at + 1] - self.bounds[at]
        entry = np.repeat(self.bounds[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cell = np.repeat(row, times) * languages + self.language[entry]
        return np.bincount(cell, self.above[entry], rows * languages).reshape(rows, languages)


@dataclass
class Model:
    """levels: words (0), then n-grams by n."""

    languages: list[str]
    levels: list[Level]

    def word_scores(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """A row of logs for each distinct word, and whether it says anything."""
        n_words, languages = len(found.hashes), len(self.languages)
        at = self.levels[0].look_up(found.hashes)
        told = at >= 0
        known = np.flatnonzero(told)
        out = self.levels[0].sums(at[known], known, n_words, languages) + self.levels[0].floor
        for n in range(LONGEST, 0, -1):
            left = np.flatnonzero(~told)
            if not len(left):
                break
            h, owner = ngrams(found, left, n)
            at = self.levels[n].look_up(h)
            hit = at >= 0
            times = np.bincount(owner[hit], minlength=len(left))
            mean = self.levels[n].sums(at[hit], owner[hit], len(left), languages) / np.maximum(times, 1)[:, None]
            out[left] = mean + self.levels[n].floor
            told[left[times > 0]] = True
        return out, told

    def predict(self, texts: pa.Array | list[str], size: int = CHARS) -> tuple[list[str], np.ndarray]:
        rows = len(texts)
        if not self.languages or not rows:
            return ["und"] * rows, np.zeros(rows)
        size = max(1, min(size, SCORES // len(self.languages)))
        has, n, total = np.zeros(rows, bool), np.zeros(rows, np.int64), np.zeros((rows, len(self.languages)))
        for of, own in blocks(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, size):
            found, of = split(own), np.array(of)
            has[of[found.row]] = True
            scores, told = self.word_scores(found)
            use = told[found.word]
            row, word = of[found.row[use]], found.word[use]
            n += np.bincount(row, minlength=rows)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, scores[word, k], rows)
        n = np.maximum(n, 1)
        mean = total / n[:, None]
        logit = mean * np.minimum(n, WORDS)[:, None]
        best = logit.argmax(axis=1)
        p = 1 / np.exp(logit - logit.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)], np.where(has, p, 0.0)


def learn(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """What reaches the driver are the counts of the sample, summed up."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn_from)
    size = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(size)
    if not languages:
        return Model([], [])
    most = min(per_language, sample / len(languages))
    of = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, most / size[lang])))])[F.col("lang")]
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    counts = own.where(chance < of).select("lang", "text").mapInArrow(_counts, "lang string, n int, hash long, count long")
    told = counts.groupBy("lang", "n", "hash").agg(F.sum("count").alias("count")).toArrow()
    lang = np.searchsorted(languages, told["lang"].to_pylist()) if told.num_rows else np.zeros(0, np.int64)
    n, h, count = (told[c].to_numpy() for c in ("n", "hash", "count"))
    return Model(languages, [Level.build(h[n == k].view(U), lang[n == k], count[n == k], len(languages)) for k in range(LONGEST + 1)])


def outside_fold(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) != 0, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score. Only the text decides; a null doc_id isn't held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch["text"])
            yield pa.record_batch([batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
