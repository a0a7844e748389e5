"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their marginals meet the targets; documents are then sampled, by a hash
of their ids, with probabilities in proportion to fitted over observed weight. The probabilities' scale makes the expected kept tokens
KEEP_SHARE of all; a cell that would need more than it has is taken whole, and its documents get a weight above 1 instead. Columns of docs named
as the results are replaced, others kept, whatever their names.

Targets map the levels of a dimension to shares; levels without one share what is left, or the target of "other". Without targets, the shares
are those of the tokens to the power TEMPER. Every source and language is a level of its own, unless the caller asks for the largest ones only
(levels; the rest is pooled). Up to DRIVER_CELLS cells are raked in the driver; more stay tables, and are raked by joins, with the same result.
Targets that no weights of the observed cells can meet are never met: if a marginal is off by more than GAP after ROUNDS rounds, that is an
error where the caller gave the targets, and a warning where they are tempered shares.

topic names a column with documents' topics. Without it a document's topic is its kind of text: the nearest of TOPICS centers in the space of
shares of byte classes and of lengths of words and lines, found by k-means over all documents with words. These don't depend on the language, so that
every language can have every topic. Texts without words have the topic "none". Features are whole multiples of 1 / UNIT, so their sums are exact
and the centers don't depend on how the documents are dealt out. They are written once; a pass of k-means sends the driver a row of sums from each task.

Null languages, sources and given topics are a level of their own, "null". Empty and null texts have no tokens: they are sampled as their cell is, but
for cells without any tokens, which are kept whole. Long texts are counted whole. Rows that repeat a doc_id share their fate. Equally near centers:
the first. No documents: no rows.
"""

from __future__ import annotations

import math
import pickle
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plandag.llm.quality import CLASSES, _class_counts
from plandag.llm.shared import drop_table, fresh, materialize
from plandag.llm.textkit import binary_rows, blocks, per_row, words

TEMPER, KEEP_SHARE, TOPICS, UNIT = 0.7, 0.5, 8, 1 << 16
DRIVER_CELLS, ROUNDS, CLOSE, GAP = 50_000, 500, 1e-10, 1e-6
DIMENSIONS = ("source", "lang", "topic")
SEED = 20_240_501
#: Byte classes that say what kind of text it is, but not in which language.
KINDS = [k for k, name in enumerate(CLASSES) if name not in ("upper", "lower", "high")]
WIDTH = len(KINDS) + 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words, and a row of features (in whole UNITs), of each text."""
    sizes, rows = [np.zeros(0, np.int64)], [np.zeros((0, WIDTH), np.int64)]
    for block in blocks(texts, lower=True):
        found = words(block)
        n = np.diff(found.first)
        counts = _class_counts(block)
        size = np.maximum(block.ends - block.starts, 1)
        length = per_row(np.add, (found.end - found.start).astype(np.float64), found.first, 0.0) / np.maximum(n, 1)
        lines = counts[:, list(CLASSES).index("line")] + 1
        own = np.column_stack([np.sqrt(counts[:, KINDS] / size[:, None]), np.log1p(length), np.log1p(n), np.log1p(n / lines)])
        rows.append(np.rint(own * UNIT).astype(np.int64))
        sizes.append(n)
    return np.concatenate(sizes), np.concatenate(rows)


#: Given a step and a fold, a pass over all rows of features: the fold of what the step gives for parts of them, None if there are no rows.
#: Both give arrays of one entry; the fold is given several, one after another.
Passes = Callable[[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]], np.ndarray | None]


def add(told: np.ndarray) -> np.ndarray:
    return told.sum(axis=0, keepdims=True)


def moments(x: np.ndarray) -> np.ndarray:
    """The number of rows; by feature the sum, and the sum of squares in two halves, so that none overflows."""
    square = x * x
    return np.concatenate([[len(x)], x.sum(axis=0), (square >> 21).sum(axis=0), (square & ((1 << 21) - 1)).sum(axis=0)])[None]


def greatest(told: np.ndarray) -> np.ndarray:
    """Of rows (score, features) the one with the greatest score; of several, that with the least features."""
    best = told[told[:, 0] == told[:, 0].max()]
    return best[np.lexsort(best[:, ::-1].T)[:1]]


@dataclass
class Topics:
    """Centers in the space of features less mean over spread."""

    mean: np.ndarray
    spread: np.ndarray
    centers: np.ndarray

    @classmethod
    def learn(cls, passes: Passes, k: int = TOPICS) -> Topics:
        """k-means, until the centers stay; each first center is the row that is furthest from those before. The largest topic comes first."""
        told = passes(moments, add)
        if told is None:
            return cls(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((0, WIDTH)))
        n, *sums = told[0].tolist()
        total, high, low = sums[:WIDTH], sums[WIDTH : 2 * WIDTH], sums[2 * WIDTH :]
        varied = [n * ((h << 21) + x) - t * t for t, h, x in zip(total, high, low, strict=True)]
        own = cls(np.array([t / n for t in total]), np.array([math.sqrt(v) / n if v else 1.0 for v in varied]), np.zeros((0, WIDTH)))
        while len(own.centers) < k:
            far = passes(own.furthest, greatest)
            if len(own.centers) and far[0, 0] <= 1e-12:
                break
            own = cls(own.mean, own.spread, np.concatenate([own.centers, own.placed(far[:, 1:])]))
        while True:  # each round brings the rows nearer to their centers, so there is an end
            size, sums = np.split(passes(own.sums, add)[0], [1], axis=1)
            new = np.where(size > 0, own.placed(sums / np.maximum(size, 1)), own.centers)
            if np.allclose(new, own.centers):
                break
            own = cls(own.mean, own.spread, new)
        return cls(own.mean, own.spread, own.centers[np.argsort(-size[:, 0], kind="stable")])

    @classmethod
    def fit(cls, x: np.ndarray, k: int = TOPICS) -> Topics:
        """learn, from rows at hand."""
        return cls.learn(lambda step, fold: step(x) if len(x) else None, k)

    def placed(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def distances(self, z: np.ndarray) -> np.ndarray:
        return np.stack([np.square(z - c).sum(axis=1) for c in self.centers], axis=1)

    def nearest(self, z: np.ndarray) -> np.ndarray:
        return self.distances(z).argmin(axis=1)

    def furthest(self, x: np.ndarray) -> np.ndarray:
        """A step: the row that is furthest from the centers, after its distance. Without centers: the one nearest to the mean."""
        z = self.placed(x)
        return greatest(np.column_stack([self.distances(z).min(axis=1) if len(self.centers) else -np.square(z).sum(axis=1), x]))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """A step: of each center's rows, the number and the sum."""
        own = self.nearest(self.placed(x))
        return np.array([[np.append((own == c).sum(), x[own == c].sum(axis=0)) for c in range(len(self.centers))]])

    def names(self, n: np.ndarray, x: np.ndarray) -> list[str]:
        if not len(self.centers):
            return ["none"] * len(n)
        return [f"topic{c}" if k else "none" for c, k in zip(self.nearest(self.placed(x)), n, strict=True)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Words, and the topic, of each text."""
        n, x = features(texts)
        return n, self.names(n, x)


def described(docs: DataFrame) -> DataFrame:
    """(source, lang, tokens, features) of each document."""
    schema = T.StructType([docs.schema["source"], docs.schema["lang"], T.StructField("tokens", T.LongType()), T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = features(batch["text"])
            yield pa.record_batch([batch["source"], batch["lang"], pa.array(n, pa.int64()), binary_rows(x.astype(np.int32))], ["source", "lang", "tokens", "features"])

    return docs.select("source", "lang", "text").mapInArrow(run, schema)


def features_of(column: pa.Array) -> np.ndarray:
    """What described() has written. All values are as wide, so they are read where they lie."""
    if not len(column):
        return np.zeros((0, WIDTH), np.int64)
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    first = np.frombuffer(offsets, np.int64)[column.offset]
    return np.frombuffer(data, np.int32, len(column) * WIDTH, first).reshape(-1, WIDTH).astype(np.int64)


def learn_topics(told: DataFrame) -> Topics:
    """From the features of all documents with words (told, from described() and written). A task folds its rows, so the driver gets one from each."""
    rows = told.where("tokens > 0").select("features")

    def passes(step: Callable[[np.ndarray], np.ndarray], fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: list[np.ndarray] = []
            for batch in batches:
                if batch.num_rows:
                    own = [fold(np.concatenate([*own, step(features_of(batch["features"]))]))]
            if own:
                yield pa.record_batch([pa.array([pickle.dumps(own[0])], pa.binary())], ["own"])

        got = [pickle.loads(r.own) for r in rows.mapInArrow(run, "own binary").collect()]
        return fold(np.concatenate(got)) if got else None

    return Topics.learn(passes)


def topics_of(told: DataFrame, topics: Topics) -> DataFrame:
    """(source, lang, tokens, topic) of what described() gives."""
    schema = T.StructType([*told.schema.fields[:3], T.StructField("topic", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = topics.names(batch["tokens"].to_numpy(), features_of(batch["features"]))
            yield pa.record_batch([batch["source"], batch["lang"], batch["tokens"], pa.array(own, pa.string())], schema.names)

    return told.mapInArrow(run, schema)


def with_topic(docs: DataFrame, carry: list[str], topics: Topics | None, given: str | None) -> DataFrame:
    """The columns to carry, with the number of words and the topic as the last two. given: the column that has it."""
    names = [fresh("__tokens", docs), fresh("__topic", docs)]
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if given is None:
                n, own = topics.of(batch["text"])
            else:
                n, own = word_counts(batch["text"]), pc.fill_null(batch[given].cast(pa.string()), "null")
            yield pa.record_batch([*(batch[c] for c in carry), pa.array(n, pa.int64()), pa.array(own, pa.string())], [*carry, *names])

    return docs.select(*dict.fromkeys([*carry, "text", *([given] if given else [])])).mapInArrow(run, schema)


def word_counts(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.diff(words(b).first) for b in blocks(texts, lower=True))])


def level(name: str, own: list[str] | None) -> Column:
    """Own names the levels that aren't pooled; None: all."""
    c = F.col(name)
    named = F.concat(F.lit("="), c)
    return F.coalesce(named if own is None else F.when(c.isin(own), named).when(c.isNotNull(), F.lit("other")), F.lit("null"))


def fit(weights: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """The cells' weights, scaled for each dimension in turn until all marginals are within close of the targets, and by how much they are off then;
    at: each cell's level of each dimension."""
    fitted = weights / weights.sum()
    marginal = lambda k: np.bincount(at[k], fitted, len(targets[k]))
    wanted = []
    for k, target in enumerate(targets):
        t = np.where(marginal(k) > 0, target, 0.0)
        wanted.append(t / t.sum())
    for _ in range(rounds):
        for k, t in enumerate(wanted):
            have = marginal(k)
            fitted = fitted * np.divide(t, have, out=np.zeros_like(t), where=have > 0)[at[k]]
        off = max(np.abs(marginal(k) - t).max() for k, t in enumerate(wanted))
        if off < close:
            break
    return fitted, float(off)


def check_gap(off: float, given: bool) -> None:
    if off > GAP:
        told = f"the targets can't be met by the observed cells: after {ROUNDS} rounds of raking a marginal is off by {off:.3g}"
        if given:
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)


def rake(weights: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """fit for a table with an axis for each dimension. Targets of empty levels go to the others."""
    at = np.nonzero(weights)
    fitted = np.zeros_like(weights, float)
    fitted[at], off = fit(weights[at], list(at), targets, rounds, close)
    check_gap(off, True)
    return fitted


def scale(tokens: np.ndarray, factor: np.ndarray, keep_share: float) -> float:
    """s with sum(tokens * min(1, s * factor)) = keep_share * sum(tokens)."""
    low, high = 0.0, 1.0
    aim = keep_share * tokens[factor > 0].sum()
    while (tokens * np.minimum(1, high * factor)).sum() < aim and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * factor)).sum() < aim else (low, mid)
    return high


def target_name(name: str) -> str | None:
    """What targets call a level; None for those that only "other" stands for."""
    return None if name in ("other", "=other", "=null") else name.removeprefix("=")


def left_over(given: dict[str, float]) -> float:
    return given["other"] if "other" in given else max(0.0, 1 - sum(given.values()))


def probabilities(cells: list[tuple], targets: dict[str, dict[str, float]] | None, temper: float, keep_share: float) -> list[tuple]:
    """cells: (source, lang, topic, tokens), each once. With the probability and the weight of each."""
    weights = np.array([c[3] for c in cells], float)
    if weights.sum() == 0:
        return [(*c[:3], 1.0, 1.0) for c in cells]
    at, wanted = [], []
    for k, dimension in enumerate(DIMENSIONS):
        names, which = np.unique(np.array([c[k] for c in cells], object), return_inverse=True)
        own = np.bincount(which, weights, len(names))
        given = (targets or {}).get(dimension)
        if given is None:
            share = np.where(own > 0, own / own.sum(), 0) ** temper * (own > 0)
        else:
            share = np.array([given.get(target_name(n), 0.0) for n in names], float)
            rest = np.array([target_name(n) not in given for n in names]) & (own > 0)
            if rest.any():
                share[rest] = left_over(given) * own[rest] / own[rest].sum()
        if share[own > 0].sum() <= 0:
            raise ValueError(f"no {dimension} with tokens has a target above 0")
        at.append(which)
        wanted.append(share)
    fitted, off = fit(weights, at, wanted)
    check_gap(off, bool(targets))
    factor = np.divide(fitted, weights / weights.sum(), out=np.zeros_like(fitted), where=weights > 0)
    aim = scale(weights, factor, keep_share) * factor
    p = np.where(weights > 0, np.minimum(1.0, aim), 1.0)
    w = np.where(weights > 0, np.divide(aim, p, out=np.zeros_like(aim), where=p > 0), 1.0)
    return [(*c[:3], *x) for c, *x in zip(cells, p.tolist(), w.tolist(), strict=True)]


def target_table(cells: DataFrame, c: str, dimension: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """(level, target) of the levels with tokens."""
    own = cells.groupBy(c).agg(F.sum("n").cast("double").alias("own")).where("own > 0")
    if given is None:
        shares = own.select(c, F.pow(F.col("own") / own.agg(F.sum("own")).first()[0], F.lit(temper)).alias("share"))
    else:
        known = F.broadcast(cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "name string, given double"))
        name = F.when(~F.col(c).isin("other", "=other", "=null"), F.regexp_replace(c, "^=", ""))
        own = materialize(own.withColumn("name", name).join(known, "name", "left").select(c, "own", "given"), "mixing-own")
        rest = own.where("given is null").agg(F.sum("own")).first()[0] or 1.0
        shares = own.select(c, F.coalesce("given", F.col("own") * F.lit(left_over(given) / rest)).alias("share"))
    shares = materialize(shares, "mixing-targets")
    whole = shares.agg(F.sum("share")).first()[0]
    if not whole or whole <= 0:
        raise ValueError(f"no {dimension} with tokens has a target above 0")
    return shares.select(c, (F.col("share") / whole).alias("target"))


def fit_table(cells: DataFrame, total: float, wanted: dict[str, DataFrame]) -> tuple[DataFrame, float]:
    """fit, by joins: the cells with tokens, with the column fitted. Each step is written, so none is computed again by the next."""
    fitted = cells.where("n > 0").withColumn("fitted", F.col("n") / F.lit(float(total)))
    last = None
    for _ in range(ROUNDS):
        for c, t in wanted.items():
            by = fitted.groupBy(c).agg(F.sum("fitted").alias("have")).join(t, c).select(c, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("by"))
            fitted = materialize(fitted.join(by, c).select("s", "l", "t", "n", (F.col("fitted") * F.col("by")).alias("fitted")), "mixing-fitted")
            if last is not None:
                drop_table(last)
            last = fitted
        off = [fitted.groupBy(c).agg(F.sum("fitted").alias("have")).join(t, c).agg(F.max(F.abs(F.col("have") - F.col("target"))).alias("off")) for c, t in wanted.items()]
        most = off[0].unionAll(off[1]).unionAll(off[2]).agg(F.max("off")).first()[0]
        if most < CLOSE:
            break
    return fitted, most


def scale_table(factors: DataFrame, keep_share: float, ways: int = 64) -> float:
    """scale, with `ways` trials in a pass over the table."""
    kept = lambda trials: factors.agg(*[F.sum(F.col("n") * F.least(F.lit(1.0), F.lit(float(x)) * F.col("factor"))).alias(f"x{k}") for k, x in enumerate(trials)]).first()
    aim = keep_share * factors.where("factor > 0").agg(F.sum("n")).first()[0]
    trials = [2.0**k for k in range(41)]
    k = next((k for k, x in enumerate(kept(trials)) if x >= aim), len(trials) - 1)
    low, high = trials[k - 1] if k else 0.0, trials[k]
    while high - low > 1e-15 * high and high > 1e-300:
        trials = sorted({low + (high - low) * k / ways for k in range(1, ways)} - {low, high})
        if not trials:
            break
        k = next((k for k, x in enumerate(kept(trials)) if x >= aim), len(trials))
        low, high = trials[k - 1] if k else low, trials[k] if k < len(trials) else high
    return high


def probability_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float, keep_share: float) -> DataFrame:
    """probabilities, where the cells (s, l, t, n) are too many for the driver."""
    total = cells.agg(F.sum("n")).first()[0]
    if not total:
        return cells.select("s", "l", "t", F.lit(1.0).alias("p"), F.lit(1.0).alias("w"))
    wanted = {c: target_table(cells, c, dimension, (targets or {}).get(dimension), temper) for c, dimension in zip("slt", DIMENSIONS, strict=True)}
    fitted, off = fit_table(cells, total, wanted)
    check_gap(off, bool(targets))
    factors = fitted.withColumn("factor", F.col("fitted") * F.lit(float(total)) / F.col("n"))
    aim = F.lit(scale_table(factors, keep_share)) * F.col("factor")
    p = F.least(F.lit(1.0), aim)
    own = factors.select("s", "l", "t", p.alias("p"), F.when(p > 0, aim / p).otherwise(0.0).alias("w"))
    return materialize(own.unionAll(cells.where("n = 0").select("s", "l", "t", F.lit(1.0), F.lit(1.0))), "mixing-chances")


def assigned(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = TEMPER,
    keep_share: float = KEEP_SHARE,
    levels: int | None = None,
    carry: list[str] | None = None,
    topic: str | None = None,
) -> DataFrame:
    """carried columns with n_tokens, topic, probability, weight and sampled. Two passes over the texts, and no shuffle of them up to DRIVER_CELLS cells."""
    carry = list(carry or docs.columns)
    told = materialize(described(docs), "mixing-features") if topic is None else None
    topics = learn_topics(told) if topic is None else None
    narrow = topics_of(told, topics) if topic is None else with_topic(docs.select("source", "lang", "text", topic), ["source", "lang"], None, topic)
    narrow = materialize(narrow.groupBy("source", "lang", narrow.columns[-1]).agg(F.sum(narrow.columns[-2]).alias("tokens")).toDF("source", "lang", "__topic", "tokens"), "mixing-cells")
    if told is not None:
        drop_table(told)
    own: dict[str, list[str] | None] = {"source": None, "lang": None}
    if levels is not None:
        largest = lambda c: [r[0] for r in narrow.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), c).limit(levels).collect()]
        own = {c: sorted({*largest(c), *(targets or {}).get(c, {})} - {"other", "null"}) for c in own}
    cells = materialize(narrow.groupBy(level("source", own["source"]).alias("s"), level("lang", own["lang"]).alias("l"), F.col("__topic").alias("t")).agg(F.sum("tokens").alias("n")), "mixing-levels")
    if cells.count() > DRIVER_CELLS:
        # Not broadcast: a plain join, which Spark splits where a cell is hot.
        chances = probability_table(cells, targets, temper, keep_share)
    else:
        got = cells.collect()
        table = probabilities(sorted((r.s, r.l, r.t, r.n) for r in got), targets, temper, keep_share) if got else []
        chances = F.broadcast(docs.sparkSession.createDataFrame(table, "s string, l string, t string, p double, w double"))
    df = with_topic(docs, list(dict.fromkeys([*carry, "doc_id", "source", "lang"])), topics, topic)
    same = (level("source", own["source"]) == chances["s"]) & (level("lang", own["lang"]) == chances["l"]) & (df[df.columns[-1]] == chances["t"])
    u = F.pmod(F.xxhash64(df["doc_id"], F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    new = {"n_tokens": df[df.columns[-2]], "topic": df[df.columns[-1]], "probability": chances["p"], "weight": chances["w"], "sampled": u < chances["p"]}
    return df.join(chances, same).select(*[df[c] for c in carry if c not in new], *[v.alias(k) for k, v in new.items()])


def report(docs: DataFrame, **options: object) -> DataFrame:
    """A row for each document: doc_id, source, lang, n_tokens, topic, probability, weight, sampled."""
    return assigned(docs, carry=["doc_id", "source", "lang"], **options)


def sample(docs: DataFrame, **options: object) -> DataFrame:
    """The sampled documents with their columns, and n_tokens, topic, probability, weight."""
    return assigned(docs, **options).where("sampled").drop("sampled")
