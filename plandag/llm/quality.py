"""Quality classifier: gradient-boosted trees over histograms of document statistics.

The trees are fitted on the driver over a bounded sample of labelled documents (SAMPLE rows, by a hash of the id) and flattened
into arrays: node k of a tree has the children 2k + 1 and 2k + 2. Scoring walks all trees of a batch with one gather a level.

Null and empty texts have statistics of zeros and are scored like any other. Long texts are described whole. Labels with a null quality, a null
doc_id or no document are left out; documents with several labels, and rows that repeat a doc_id, count once for each. Of cuts that gain equally, the
first feature's lowest one is taken; labels beyond the sample are left in the order of the ids' hashes. Without labels every score is 0.5; no
documents: no rows. score() leaves columns besides doc_id and text aside, keep_good() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.llm.textkit import Block, Words, blocks, grams, per_row, word_hashes, words

#: At most so many labelled documents are learned from.
SAMPLE = 20_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3

#: Byte classes whose shares are statistics.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "stop": map(ord, ".,;:?"), "bang": (33,), "pipe": (124,), "symbol": map(ord, "#$%&*+/<=>@\\^_`{}~"), "bracket": map(ord, "()[]'\"-"), "high": range(128, 256)}
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _k


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many different values it has, and the count of its most frequent one."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(v)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[new], runs)
    return np.bincount(r[new], minlength=rows), most


def _class_counts(block: Block, piece: int = 1 << 20) -> np.ndarray:
    rows, classes = len(block.starts), len(CLASSES) + 1
    out = np.zeros(rows * classes, np.int64)
    for low in range(0, len(block.data), piece):
        high = min(low + piece, len(block.data))
        inside = np.maximum(np.minimum(block.ends, high) - np.maximum(block.starts, low), 0)
        out += np.bincount(np.repeat(np.arange(rows) * classes, inside) + CLASS_OF[block.data[low:high]], minlength=len(out))
    return out.reshape(rows, classes)


def statistics(block: Block, found: Words | None = None) -> np.ndarray:
    """A row of statistics for each text."""
    rows = len(block.starts)
    size = (block.ends - block.starts).astype(np.float64)
    one = np.maximum(size, 1)
    shares = _class_counts(block)
    found = found or words(block)
    n = np.diff(found.first).astype(np.float64)
    many = np.maximum(n, 1)
    lengths = (found.end - found.start).astype(np.float64)
    mean = per_row(np.add, lengths, found.first, 0.0) / many
    square = per_row(np.add, lengths**2, found.first, 0.0) / many
    hashes = word_hashes(block, found)
    distinct, most = _distinct(hashes, found.row, rows)
    pair, at = grams(hashes, found.row, 2)
    pairs, most_pair = _distinct(pair, found.row[at], rows)
    again = np.zeros(rows)
    if len(hashes) > 1:
        again = np.bincount(found.row[1:][(hashes[1:] == hashes[:-1]) & (found.row[1:] == found.row[:-1])], minlength=rows)
    short = np.bincount(found.row[lengths <= 3], minlength=rows)
    long = np.bincount(found.row[lengths >= 12], minlength=rows)
    lines = shares[:, list(CLASSES).index("line")] + 1
    out = [np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(square - mean**2, 0)), per_row(np.maximum, lengths, found.first, 0.0)]
    out += [distinct / many, most / many, pairs / many, most_pair / many, again / many, short / many, long / many, np.log(lines), n / lines]
    return np.column_stack([*out, shares / one[:, None]]).astype(np.float32)


@dataclass
class Trees:
    """feature, threshold: trees x inner nodes; leaf: trees x leaves; a value above the threshold goes right."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all nodes are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss. least: sum of second derivatives that a child must have."""
    inner = 2**depth - 1
    if not len(x) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    features = x.shape[1]
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), start)
    out_f, out_t, out_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    column = np.arange(features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            cell = ((node - base)[:, None] * (features * bins) + column + binned).ravel()
            sums = [np.bincount(cell, np.repeat(v, features), width * features * bins).reshape(width, features, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
            gain[(hl < least) | (hr < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    out_f[t, base + k], out_t[t, base + k] = f, cuts[f][b]
            right = x[np.arange(len(y)), out_f[t, node]] > out_t[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        out_l[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += out_l[t, leaf]
    return Trees(start, out_f, out_t, out_l)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = np.concatenate([statistics(b) for b in blocks(batch["text"])])
            yield pa.record_batch([batch["doc_id"], pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "statistics"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """From labels outside the fold that is held out. The sample's bound is what makes its broadcast safe."""
    known = labels.where("quality in (0, 1)").where(fold(F.col("doc_id")) != 0).select(F.col("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    told = texts.mapInArrow(_described, "doc_id long, statistics binary").join(F.broadcast(known), "doc_id").toPandas()
    told = told.sort_values(["doc_id", "y", "statistics"], ignore_index=True)
    x = np.frombuffer(b"".join(told["statistics"]), np.float32).reshape(len(told), -1 if len(told) else 1)
    return fit(x, told["y"].to_numpy(np.float64))


def _scores(texts: pa.Array, model: Trees) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.score(statistics(b)) for b in blocks(texts))])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted. A null doc_id isn't held out; it is never learned from either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array(_scores(batch["text"], model), pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The documents that aren't rejected, with all their columns, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch["text"], model) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
