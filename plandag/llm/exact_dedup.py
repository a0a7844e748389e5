"""Exact deduplication against a minimal perfect hash over the distinct digests of a history.

The history's distinct digests are dealt into shards. Each shard is a minimal perfect hash: levels of bits, in which a digest
that meets no other takes the place it hashes to, and the others go on to the next level; the rank of that bit is the slot.
A slot holds the full digest and the locator of its winner. A lookup compares the full digest's bytes, so a digest that
is not in the history is never taken for a member. Members are repeats of the winner; nonmembers are grouped among themselves.

Both sides are summed up by digest before they meet, so a group of copies is one row there, however large it is.

Null and empty texts are equal. Of equal texts the row with the smallest doc_id stays; null doc_ids lose against any other.
Rows that repeat a doc_id with an equal text are equal rows: report() marks each of them as kept, drop_copies() returns one of them.
Long texts are hashed whole. No documents: no rows. report() leaves columns besides doc_id and text aside, drop_copies() keeps them, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.llm.shared import materialize, row_key, rows_with_keys
from plandag.llm.textkit import U, mix

#: Runs of these count as one space.
BLANKS = "[\\x20\\x09-\\x0D]+"
KEYS_PER_SHARD = 1 << 14


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def half(doc_id: Column) -> Column:
    """Where no history is given: every second document, by a hash of its id, counts as seen before."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0


class PerfectHash:
    """keys: distinct rows of four 64-bit words."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        self.bits, self.sizes = bits, sizes
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits) - 1

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        word = keys[:, level % 4] ^ mix(keys[:, (level + 1) % 4] + U(level + 1))
        return (mix(word) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, 2 * len(left))
            at = cls.places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(np.concatenate([np.zeros(0, bool), *levels]), np.array([len(x) for x in levels], np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """For keys it was built on, their slots; for others any slot, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.offsets[level] + self.places(keys[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


INDEX = "shard long, bits binary, sizes array<long>, slots binary, winners array<long>, counts array<long>"


def _build_shard(table: pa.Table) -> pa.Table:
    keys = _keys(table["digest"])
    made = PerfectHash.build(keys)
    order = np.empty(len(keys), np.int64)
    order[made.slots(keys)] = np.arange(len(keys))
    held = table.take(pa.array(order))
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    row = [table["shard"][0].as_py(), np.packbits(made.bits).tobytes(), made.sizes.tolist(), keys[order].tobytes(), held["winner"].to_pylist(), held["n"].to_pylist()]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


GROUPS = "digest binary, keep_id long, group_size long, known boolean"


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    """All groups of a shard: the history's, with the members added, and those of nonmembers."""
    digests, keep, size, known = [], [], [], []
    member = np.zeros(new.num_rows, bool)
    if index.num_rows:
        row = index.to_pylist()[0]
        sizes = np.array(row["sizes"], np.int64)
        made = PerfectHash(np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool), sizes)
        slots, winners, counts = np.frombuffer(row["slots"], "<u8").reshape(-1, 4), row["winners"], row["counts"]
        if new.num_rows:
            keys = _keys(new["digest"])
            at = made.slots(keys)
            member = (at >= 0) & (slots[at] == keys).all(axis=1)
            for slot, winner, n in zip(at[member], new["winner"].filter(pa.array(member)).to_pylist(), new["n"].filter(pa.array(member)).to_pylist(), strict=True):
                winners[slot] = min((x for x in (winners[slot], winner) if x is not None), default=None)
                counts[slot] += n
        raw = slots.tobytes()
        digests += [raw[i : i + 32] for i in range(0, len(raw), 32)]
        keep, size, known = winners, counts, [True] * len(winners)
    if new.num_rows:
        alone = new.filter(pa.array(~member))
        digests, keep, size, known = digests + alone["digest"].to_pylist(), keep + alone["winner"].to_pylist(), size + alone["n"].to_pylist(), known + [False] * alone.num_rows
    return pa.table([pa.array(digests, pa.binary()), pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(known, pa.bool_())], ["digest", "keep_id", "group_size", "known"])


def digests(docs: DataFrame, in_history: Column | None = None) -> DataFrame:
    """(doc_id, digest, seen), written once, so that the texts are read and hashed once."""
    seen = half(docs["doc_id"]) if in_history is None else F.coalesce(in_history, F.lit(False))
    return materialize(docs.select("doc_id", F.unhex(F.sha2(normalized(docs["text"]), 256)).alias("digest"), seen.alias("seen")), "digests")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: (digest, winner, n, shard) with distinct digests. One row a shard."""
    return materialize(history.groupBy("shard").applyInArrow(_build_shard, INDEX), "perfect-hash")


def groups(hashed: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """(digest, keep_id, group_size, known) for each distinct digest of digests(); known: it is one of the history's."""
    shards = max(1, -(-hashed.where("seen").count() // keys_per_shard))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    summed = lambda side: side.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")).select("*", shard)
    index = build_index(summed(hashed.where("seen")), shards)
    return index.groupBy("shard").cogroup(summed(hashed.where(~F.col("seen"))).groupBy("shard")).applyInArrow(_look_up, GROUPS)


def report(docs: DataFrame, in_history: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256. docs needs doc_id and text; other columns are left aside."""
    hashed = digests(docs.select("doc_id", "text") if in_history is None else docs, in_history)
    found = groups(hashed)
    out = hashed.select("doc_id", "digest").join(found.select("digest", "keep_id", "group_size"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, one for each group of equal texts, with all their columns."""
    kept = report(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return rows_with_keys(docs, row_key(docs["doc_id"], F.sha2(normalized(docs["text"]), 256)), kept, F.lit(True))
