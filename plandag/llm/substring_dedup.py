"""Removal of repeated substrings: every byte covered by a string of LENGTH bytes that also starts anywhere else goes.

A window is a string of LENGTH bytes within one document's UTF-8 text. Each window has an anchor: of the strings of ANCHOR bytes in it
the one with the smallest hash (ties: the first). The anchor depends on the window's bytes alone, so equal windows have equal
anchors at equal distances, and only windows of equal anchors need comparing. Successive windows mostly share their anchor: a
run of them with the bytes it covers is an occurrence of the anchor.

1. Occurrences are summed up by anchor and a digest of the covered bytes (BLAKE2b, 128 bits, so equal digests are taken for equal bytes). If the
   same bytes occur twice, all their windows are repeated. This sums up exact copies before anything is shuffled, whatever their number.
2. What is left, distinct occurrences of one anchor, goes to a suffix array: their suffixes from the anchor on are sorted by a merge sort
   whose comparisons find the common extension by binary search over prefix polynomial hashes. Windows at a distance d from the
   anchor are equal if their suffixes lie in one run of common extensions of LENGTH - d or more and the d bytes before are equal.
3. What polynomial hashes have found equal is compared byte by byte; a group with a collision is done again on the bytes themselves.
4. An anchor with more than HOT distinct occurrences is dealt into tasks. Each sorts its part and tells a digest (as in 1) of each distinct window;
   windows that several parts have are then marked in each of those parts, which are sorted once more.

Repeats are judged on the input. Null texts count as empty; texts of less than LENGTH bytes keep all; long texts are worked on in pieces that
overlap. Rows that repeat a doc_id are documents of their own; rows that repeat doc_id and text repeat each other's substrings. No documents: no
rows. Columns besides doc_id and text are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plandag.llm.shared import drop_table, materialize
from plandag.llm.textkit import BLOCK, Block, U, blocks, mix, powers, prefix_hash, span_hash, whole_groups

#: HOT occurrences take about 400 MB in the task that sorts them.
LENGTH, ANCHOR, HOT = 400, 64, 8192
LOW = U(0xFFFFFFFF)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width values in a row, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    cells = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def occurrences(block: Block, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: row, first window, last window, anchor's place (all within the text), the anchor's hash, and where the
    covered bytes begin and end in the block."""
    prefix = prefix_hash(block.data)
    starts = np.arange(max(0, len(block.data) - anchor + 1))
    if len(block.data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U), none, none
    # BASE**-k by place, then mixed: as span_hash(), without a gather
    gram = mix((prefix[anchor:] - prefix[: len(starts)]) * powers(len(prefix), "down")[: len(starts)])
    at = (sliding_min((gram & ~LOW) | starts.astype(U), length - anchor + 1) & LOW).astype(np.int64)
    long = np.flatnonzero(block.ends - block.starts >= length)
    last = block.ends[long] - length
    inside = np.zeros(len(at) + 1, np.int32)
    inside[block.starts[long]] += 1
    np.add.at(inside, last + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    new[block.starts[long]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(block.ends, first, side="right")
    end = np.append(first[1:], len(at)) - 1
    end = np.minimum(end, block.ends[row] - length)
    p = at[first]
    zero = block.starts[row]
    return row, first - zero, end - zero, p - zero, gram[p], first, end + length


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two numbers for each of the strings."""
    told = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(told), np.int64).reshape(-1, 2)


FOUND = "doc_id long, text_hash long, anchor long, c1 long, c2 long, first int, last int, at int"


def pieces(block: Block, length: int, size: int) -> Iterator[tuple[Block, int]]:
    """A long text in pieces, and where each begins: every window lies in one, and its anchor is the same there."""
    if len(block.starts) > 1 or len(block.data) <= 2 * size:
        yield block, 0
        return
    for low in range(0, len(block.data) - length + 1, size):
        data = block.data[low : low + size + length - 1]
        yield Block(block.first, data, np.array([0]), np.array([len(data)])), low


def _find(length: int, anchor: int, size: int = BLOCK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, low in (p for b in blocks(batch["text"], size) for p in pieces(b, length, size)):
                row, first, last, at, gram, begin, end = occurrences(block, length, anchor)
                rows, covered = pa.array(row + block.first), digests(block.data.tobytes(), begin, end)
                columns = [batch["doc_id"].take(rows), batch["text_hash"].take(rows), *(pa.array(x) for x in (gram.view(np.int64), covered[:, 0], covered[:, 1]))]
                columns += [pa.array((x + low).astype(np.int32)) for x in (first, last, at)]
                yield pa.record_batch(columns, [x.split()[0] for x in FOUND.split(", ")])

    return run


CUT = "doc_id long, text_hash long, anchor long, first int, last int, at int, n long, salt int, bytes binary"
#: Documents of a batch that are taken apart at once.
ROWS = 256


def _cut(length: int, held: int = 1 << 22):
    """The covered bytes of a document's occurrences, in batches of about so many bytes."""
    names, kinds = zip(*(x.split() for x in CUT.split(", ")), strict=True)
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            for doc_id, text_hash, text, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_hash", "text", "own")), strict=True):
                data = text.encode()
                for x in own:
                    rows.append((doc_id, text_hash, x["anchor"], x["first"], x["last"], x["at"], x["n"], x["salt"], data[x["first"] : x["last"] + length]))
                    size += len(rows[-1][-1])
                    if size >= held:
                        yield pa.record_batch([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))
                        rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return run


class Suffixes:
    """Suffixes data[start:end], in groups that lie one after another. Sorted within each group by a merge sort on hashed comparisons."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> None:
        self.data, self.start, self.end = data, start, end
        self.prefix = prefix_hash(data)
        self.down = powers(len(self.prefix), "down")
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        self.size = np.repeat(np.diff(np.append(head, len(group))), np.diff(np.append(head, len(group))))
        self.head = np.repeat(head, np.diff(np.append(head, len(group))))
        self.order = self.sort()

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n bytes from places a and b have equal hashes."""
        return (self.prefix[a + n] - self.prefix[a]) * self.down[a] == (self.prefix[b + n] - self.prefix[b]) * self.down[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search."""
        sa, sb = self.start[a], self.start[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.end[a] - sa, self.end[b] - sb)
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            ok = self.same(sa, sb, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        ea, eb = self.end[a] - self.start[a] <= n, self.end[b] - self.start[b] <= n
        ca = self.data[np.minimum(self.start[a] + n, len(self.data) - 1)]
        cb = self.data[np.minimum(self.start[b] + n, len(self.data) - 1)]
        return np.where(ea | eb, np.where(ea & eb, or_equal, ea), ca < cb)

    def sort(self) -> np.ndarray:
        n = len(self.start)
        order, width = np.arange(n), 1
        while width < self.size.max(initial=0):
            slot = np.flatnonzero(self.size > width)
            head, size = self.head[slot], self.size[slot]
            local = slot - head
            run = local // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, size), np.minimum(other + width, size)
            base = low.copy()
            me, late = order[slot], (run & 1).astype(bool)  # the left run's elements come first among equals
            active = np.flatnonzero(low < high)
            while len(active):
                mid = (low[active] + high[active]) >> 1
                before = self.less(order[head[active] + mid], me[active], late[active])
                low[active] = np.where(before, mid + 1, low[active])
                high[active] = np.where(before, high[active], mid)
                active = active[low[active] < high[active]]
            to = head + (run & ~1) * width + local % width + (low - base)
            order[to] = me
            width *= 2
        return order


def repeated(data: np.ndarray, begin: np.ndarray, at: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its occurrence, its start in data, and the number of a window that stands for all equal ones.

    data: covered bytes of all occurrences; begin: where each one's begin; at: anchors in data; windows: their number.
    """
    end = begin + windows + length - 1
    s = Suffixes(data, at, end, group)
    if not len(begin):
        return begin, begin, begin
    sorted_common = np.zeros(len(begin), np.int64)
    same_group = group[s.order[1:]] == group[s.order[:-1]]
    sorted_common[1:] = np.where(same_group, s.common(s.order[1:], s.order[:-1]), 0)
    rank = np.empty(len(begin), np.int64)
    rank[s.order] = np.arange(len(begin))
    owner = np.repeat(np.arange(len(begin)), windows)
    start = np.repeat(begin, windows) + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    d = at[owner] - start
    run = np.empty(len(owner), np.int64)
    by_distance = np.argsort(d, kind="stable")
    edges = np.searchsorted(d[by_distance], np.arange(int(d.max(initial=0)) + 2))
    for k in range(len(edges) - 1):
        own = by_distance[edges[k] : edges[k + 1]]
        if len(own):
            run[own] = np.cumsum(sorted_common < length - k)[rank[owner[own]]]
    key = mix(span_hash(s.prefix, start, at[owner]) + mix(run.astype(U) * U(1 << 10) + d.astype(U)))
    _, first, stands = np.unique(key, return_index=True, return_inverse=True)
    stands = first[stands]
    # Byte by byte: stretches of windows of one occurrence that stand for those of another one.
    claim = np.flatnonzero(stands != np.arange(len(stands)))
    if len(claim):
        mine, theirs = start[claim], start[stands[claim]]
        cut = np.flatnonzero(np.append(True, (np.diff(mine) != 1) | (np.diff(theirs) != 1) | (np.diff(owner[claim]) != 0)))
        raw = data.tobytes()
        for i, j in zip(cut, np.append(cut[1:], len(claim)), strict=True):
            n = int(mine[j - 1] - mine[i]) + length
            if raw[mine[i] : mine[i] + n] != raw[theirs[i] : theirs[i] + n]:
                seen: dict[bytes, int] = {}
                return owner, start, np.array([seen.setdefault(raw[p : p + length], k) for k, p in enumerate(start)])
    return owner, start, stands


SPANS = "doc_id long, text_hash long, first int, last int, part long, d1 long, d2 long"


class Part:
    """Occurrences sorted, and for each window its occurrence, its place in the document, the window that stands for it, and how many that is."""

    def __init__(self, table: pa.Table, length: int) -> None:
        self.length, self.table = length, table.combine_chunks()
        size = pc.binary_length(self.table["bytes"]).to_numpy().astype(np.int64)
        self.raw = b"".join(x.as_buffer() for x in self.table["bytes"])
        begin = np.cumsum(size) - size
        first, last, at, self.n, self.salt = (self.table[c].to_numpy().astype(np.int64) for c in ("first", "last", "at", "n", "salt"))
        self.part = self.table["part"].to_numpy()
        self.owner, self.start, self.stands = repeated(np.frombuffer(self.raw, np.uint8), begin, begin + at - first, last - first + 1, self.part, length)
        self.place = self.start - begin[self.owner] + first[self.owner]
        self.times = np.bincount(self.stands, minlength=len(self.stands))[self.stands]

    def stretches(self, told: np.ndarray) -> pa.RecordBatch:
        """Of the chosen windows, in order: runs that follow one another in one occurrence."""
        new = np.ones(len(told), bool)
        new[1:] = (np.diff(self.place[told]) != 1) | (np.diff(self.owner[told]) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(told))[: len(first)] - 1
        return self.rows(self.owner[told[first]], self.place[told[first]], self.place[told[last]], None)

    def rows(self, owner: np.ndarray, first: np.ndarray, last: np.ndarray, digest: np.ndarray | None) -> pa.RecordBatch:
        own = self.table.select(["doc_id", "text_hash"]).take(pa.array(owner))
        marks = [pa.nulls(len(owner), pa.int64())] * 2 if digest is None else [pa.array(digest[:, k]) for k in (0, 1)]
        ids = [own[c].combine_chunks() for c in ("doc_id", "text_hash")]
        return pa.record_batch([*ids, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(self.part[owner]), *marks], [x.split()[0] for x in SPANS.split(", ")])

    def digests(self, which: np.ndarray) -> np.ndarray:
        return digests(self.raw, self.start[which], self.start[which] + self.length)


def _sort(length: int):
    """Stretches of repeated windows (d1 null); of dealt anchors also a digest of each distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part", 4000, 1 << 22):
            own = Part(table, length)
            yield own.stretches(np.flatnonzero((own.times > 1) & (own.n[own.owner] == 1)))
            once = np.flatnonzero((own.salt[own.owner] >= 0) & (own.stands == np.arange(len(own.stands))))
            yield own.rows(own.owner[once], own.place[once], own.place[once], own.digests(once))

    return run


def _sort_again(length: int):
    """Of a dealt anchor's part, given digests of windows that other parts have too: stretches of those that occur here once."""

    def run(cut: pa.Table, elsewhere: pa.Table) -> pa.Table:
        if not cut.num_rows or not elsewhere.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int32() if x.endswith(" int") else pa.int64()) for x in SPANS.split(", ")})
        own = Part(cut, length)
        once = np.flatnonzero((own.times == 1) & (own.n[own.owner] == 1))
        wanted = set(zip(elsewhere["d1"].to_pylist(), elsewhere["d2"].to_pylist(), strict=True))
        hit = np.fromiter((tuple(d) in wanted for d in own.digests(once).tolist()), bool, len(once))
        return pa.Table.from_batches([own.stretches(once[hit])])

    return run


def spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """texts: (doc_id, text, text_hash). (doc_id, text_hash, first, last): windows that start from first to last are repeated."""
    found = materialize(texts.mapInArrow(_find(length, anchor), FOUND), "occurrences")
    key = ["anchor", "c1", "c2"]
    one = F.struct("doc_id", "text_hash", "first", "last", "at")
    alike = materialize(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), "covered-bytes")
    copies = found.join(alike.where("n > 1").select(*key), key).select("doc_id", "text_hash", "first", "last")

    # Written first: the join is then one of two plain exchanges, whose skewed partitions Spark splits.
    several = materialize(alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("distinct")).where("distinct > 1"), "open-anchors")
    parts = F.ceil(F.col("distinct") / hot)
    salt = F.when(parts > 1, F.pmod(F.xxhash64("c1"), parts)).otherwise(F.lit(-1)).cast("int")
    open_ones = alike.join(several, "anchor").withColumn("salt", salt)
    each = F.struct("anchor", *[F.col(f"one.{c}").alias(c) for c in ("first", "last", "at")], "n", "salt")
    own = open_ones.groupBy(F.col("one.doc_id").alias("wanted"), F.col("one.text_hash").alias("wanted_hash")).agg(F.collect_list(each).alias("own"))
    same = texts["doc_id"].eqNullSafe(own["wanted"]) & (texts["text_hash"] == own["wanted_hash"])
    # Rows that repeat doc_id and text have no open occurrence: their bytes occur twice. They are read once, as witnesses.
    cut = texts.join(own, same).select("doc_id", "text_hash", "text", "own").mapInArrow(_cut(length), CUT)
    cut = materialize(cut.withColumn("part", F.xxhash64("anchor", "salt")), "cut")
    told = materialize(cut.repartition("part").sortWithinPartitions("part").mapInArrow(_sort(length), SPANS), "spans")
    out = told.where("d1 is null").select("doc_id", "text_hash", "first", "last")
    dealt = told.where("d1 is not null")
    if not dealt.isEmpty():
        twice = dealt.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("d1", "d2")
        elsewhere = dealt.select("part", "d1", "d2").join(twice, ["d1", "d2"], "left_semi")
        again = cut.where("salt >= 0").groupBy("part").cogroup(elsewhere.groupBy("part")).applyInArrow(_sort_again(length), SPANS)
        out = out.unionAll(materialize(again.select("doc_id", "text_hash", "first", "last"), "dealt-spans"))
    for done in (several, cut):
        drop_table(done)
    return copies.unionAll(out)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans; adjacent ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _remove(length: int, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            out: list[tuple] = []
            for text, own in zip(batch["text"].to_pylist(), batch["own"].to_pylist(), strict=True):
                data = text.encode()
                gone = merged([x["first"] for x in own or ()], [x["last"] + length for x in own or ()])
                kept = data if not gone else b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *([gone_text(gone), kept] if want_text else [])))
            cols = list(zip(*out, strict=True)) or [()] * (6 if want_text else 4)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], ["doc_id", *names[: len(cols)]])

    return run


def gone_text(gone: list[tuple[int, int]]) -> str:
    return ",".join(f"{a}:{b}" for a, b in gone)


def report(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, want_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with want_text also the removed spans (start:end, bytes) and what is kept."""
    if not 0 < anchor <= length:
        raise ValueError("anchor must be from 1 to length")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    own = spans(texts, length, anchor, hot).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("own"))
    own = own.withColumnsRenamed({"doc_id": "wanted", "text_hash": "wanted_hash"})
    same = texts["doc_id"].eqNullSafe(own["wanted"]) & (texts["text_hash"] == own["wanted_hash"])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed string, kept binary" * want_text
    return texts.join(own, same, "left").select("doc_id", "text", "own").mapInArrow(_remove(length, want_text), schema)
