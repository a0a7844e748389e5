"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are compared lower-cased. Seeds, SEED words in a row, that a document shares with an item make the
pair a candidate if they could cover enough of the item, each seed counted as often as it stands in the item. For a candidate, Karp-Rabin runs
find the longest stretches of unmarked words that both have; the longest are marked, without overlap, and the search is repeated until none of
SEED words is left. Of equally long ones, the first in the order of their distance, then of the document, is marked first.
The share of the item's words that is marked is the coverage: reordered passages reach it as well as unbroken ones.
An item of fewer than SEED words is its own seed: it is covered where all of it stands in a row, and not otherwise.

The benchmark is taken in blocks of at most about BLOCK_CHARS characters, each broadcast and held against all documents, so what is
broadcast has a bound whatever the benchmark's size. Documents aren't shuffled.

Null texts count as empty; they, and items without words, match nothing. Long and repetitive texts are tiled whole; of their common stretches only
the ends are held, PLACES pairs of places at a time. Items that repeat an item_id or a text are matched one by one; rows that repeat a doc_id
likewise. No documents or no items: no leaks. report() leaves columns besides doc_id and text aside, drop_contaminated() keeps them, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.llm.shared import fresh, materialize, row_key
from plandag.llm.textkit import blocks, grams, mix, word_hashes, words

SEED, COVER, BLOCK_CHARS = 4, 0.5, 8_000_000
#: Pairs of places that are held at once in the search for common stretches.
PLACES = 1 << 20


def seed_size(item: np.ndarray) -> int:
    return min(SEED, max(1, len(item)))


def seeds_of(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of so many words in a row, others for each size, and where they begin."""
    value, at = grams(hashes, row, size)
    return mix(value + np.uint64(size)), at


@dataclass
class Items:
    """ids, and the word hashes of each; sorted seeds, with the items that have each (postings from bounds[k] to bounds[k + 1]), and how often;
    the fewest seeds that a candidate shares with each, and the seeds' numbers of words."""

    ids: list[int | None]
    hashes: list[np.ndarray]
    seeds: np.ndarray
    bounds: np.ndarray
    postings: np.ndarray
    times: np.ndarray
    least: np.ndarray
    sizes: list[int]

    @classmethod
    def build(cls, ids: list[int | None], texts: list[str | None], cover: float) -> Items:
        own: list[np.ndarray] = []
        for block in blocks(pa.array(texts, pa.string()), lower=True):
            found = words(block)
            own += np.split(word_hashes(block, found), found.first[1:-1])
        pairs = [np.unique(seeds_of(h, np.zeros(len(h), np.int64), seed_size(h))[0], return_counts=True) for h in own]
        seeds = np.concatenate([np.zeros(0, np.uint64), *(p for p, _ in pairs)])
        times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in pairs)])
        item = np.repeat(np.arange(len(own)), [len(p) for p, _ in pairs])
        order = np.argsort(seeds, kind="stable")
        seeds, first = np.unique(seeds[order], return_index=True)
        # Tiles of SEED words cover most for their number of seed places; a seed that repeats in the item has several.
        least = np.array([max(1, -(-int(np.ceil(cover * len(h) - 1e-9)) // SEED)) for h in own], np.int64)
        return cls(ids, own, seeds, np.append(first, len(item)), item[order], times[order], least, sorted({seed_size(h) for h in own if len(h)}))


def matches(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal common stretches of n or more free words: starts in the document and in the item, and lengths. What lies between their ends isn't held."""

    def stretches(own: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n words in a row, and whether they are free; before the first and after the last stands one that isn't."""
        ok = np.convolve(free, np.ones(n, np.int64), "valid") == n if len(free) >= n else np.zeros(0, bool)
        return np.pad(grams(own, np.zeros(len(own), np.int64), n)[0], 1), np.pad(ok, 1)

    (ha, fa), (hb, fb) = stretches(doc, doc_free), stretches(item, item_free)
    a, b = np.flatnonzero(fa), np.flatnonzero(fb)
    b = b[np.argsort(hb[b], kind="stable")]
    low, times = np.searchsorted(hb[b], ha[a], "left"), np.searchsorted(hb[b], ha[a], "right")
    times -= low
    a, low, times = a[times > 0], low[times > 0], times[times > 0]
    ends: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(times) // PLACES)) + 1):
        t = times[part]
        i = np.repeat(a[part], t)
        j = b[np.repeat(low[part], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)]
        for k, step in enumerate((-1, 1)):
            end = ~(fa[i + step] & fb[j + step] & (ha[i + step] == hb[j + step]))
            ends[2 * k].append(i[end])
            ends[2 * k + 1].append(j[end])
    i, j, last, last_j = map(np.concatenate, ends)
    order = np.lexsort((i, i - j))
    last = last[np.lexsort((last, last - last_j))]
    return i[order] - 1, j[order] - 1, last - i[order] + n


def tile(doc: np.ndarray, item: np.ndarray, n: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles as (start in the document, start in the item, length), longest first."""
    doc_free, item_free, out = np.ones(len(doc), np.int64), np.ones(len(item), np.int64), []
    while True:
        i, j, length = matches(doc, item, doc_free, item_free, n)
        if not len(i):
            return out
        best = length.max()
        i, j = i[length == best], j[length == best]
        while len(i):
            a, b = i[0], j[0]
            doc_free[a : a + best] = item_free[b : b + best] = 0
            out.append((int(a), int(b), int(best)))
            free = (np.abs(i - a) >= best) & (np.abs(j - b) >= best)
            i, j = i[free], j[free]


def leaks(texts: pa.Array, items: Items, cover: float = COVER) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) of all pairs that reach the coverage."""
    out = []
    if not len(items.seeds):
        return out
    for block in blocks(texts, lower=True):
        found = words(block)
        hashes = word_hashes(block, found)
        met = []
        for size in items.sizes:
            seed, at = seeds_of(hashes, found.row, size)
            k = np.minimum(np.searchsorted(items.seeds, seed), len(items.seeds) - 1)
            hit = items.seeds[k] == seed
            met.append(np.unique(found.row[at[hit]] * np.int64(len(items.seeds)) + k[hit]))  # seeds of each row, once
        met = np.concatenate(met)
        row, k = np.divmod(met, len(items.seeds))
        times = items.bounds[k + 1] - items.bounds[k]
        posting = np.repeat(items.bounds[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pair, which = np.unique(np.repeat(row, times) * np.int64(len(items.ids)) + items.postings[posting], return_inverse=True)
        seeds = np.bincount(which, items.times[posting], len(pair))
        for p in pair[seeds >= items.least[pair % len(items.ids)]]:
            r, i = divmod(int(p), len(items.ids))
            tiles = tile(hashes[found.first[r] : found.first[r + 1]], items.hashes[i], seed_size(items.hashes[i]))
            if sum(t[2] for t in tiles) >= cover * len(items.hashes[i]):
                out.append((block.first + r, i, tiles))
    return out


def in_blocks(benchmark: DataFrame, cover: float, block_chars: int) -> Iterator[Items]:
    """The benchmark, collected block by block."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for k in range(n):
        own = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = own.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toArrow()
        yield Items.build(got["item_id"].to_pylist(), got["text"].to_pylist(), cover)


PAIRS = "doc_id long, text_hash long, item_id long, coverage double, n_tiles long, longest long, item_words long"


def _pairs(docs: DataFrame, items: Items, cover: float) -> tuple[DataFrame, Broadcast]:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = leaks(batch["text"], held.value, cover)
            rows = pa.array([r for r, *_ in got], pa.int64())
            tiles = [[t[2] for t in x] for *_, x in got]
            n = [len(held.value.hashes[i]) for _, i, _ in got]
            cols = [[held.value.ids[i] for _, i, _ in got], [sum(x) / m for x, m in zip(tiles, n, strict=True)], [len(x) for x in tiles], [max(x) for x in tiles], n]
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            told = [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]
            yield pa.record_batch([batch["doc_id"].take(rows), batch["text_hash"].take(rows), *told], [x.split()[0] for x in PAIRS.split(", ")])

    return docs.select("doc_id", "text", text_hash(docs).alias("text_hash")).mapInArrow(run, PAIRS), held


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def all_pairs(docs: DataFrame, benchmark: DataFrame, cover: float, block_chars: int) -> DataFrame:
    """One pass over the documents for each block; only one block is held at a time."""
    out, held = None, None
    for items in in_blocks(benchmark, cover, block_chars):
        if held is not None:
            out = materialize(out, "leaks")
            held.destroy()
        own, held = _pairs(docs, items, cover)
        out = own if out is None else out.unionAll(own)
    return out


def report(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each leak: doc_id, item_id, the coverage, the number of tiles, the words of the longest one and of the item."""
    return all_pairs(docs, benchmark, cover, block_chars).drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that leak no item, with all their columns. A benchmark of one block takes one pass and no shuffle; of more, the leaks are joined back."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > block_chars:
        leaking = all_pairs(docs, benchmark, cover, block_chars).select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key")).distinct()
        name = fresh("__key", docs)
        own = docs.withColumn(name, row_key(docs["doc_id"], text_hash(docs)))
        return own.join(leaking.select(F.col("key").alias(name)), name, "left_anti").select(*docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(next(in_blocks(benchmark, cover, block_chars)))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in leaks(batch["text"], held.value, cover)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
