"""N-gram Jaccard join: all documents whose sets of word 5-grams have a Jaccard similarity of THRESHOLD or more.

1. Texts of equal word sequences fall into one representative; copies are only counted from here on.
2. MinHash LSH forest: a signature has DEPTH values for each of TREES tries. A trie is kept as its sorted signatures: rows are dealt out by
   the shortest prefix that is ever matched and sorted by what follows it, a byte a level. Matched prefixes are shortened level by level,
   from DEPTH to the length at which a pair at the threshold meets in some trie with TARGET_RECALL or more.
3. On each level but the last, members of a trie's node that agree with its smallest one in TWINS are its twins: their prefixes aren't shortened
   further, it goes on for them. So of nearly equal texts, however many, few reach the shortest prefix. There, from the smallest on, each member
   that nothing covers yet covers what agrees with it in COVERS: far less than the threshold, since copies of one text that each differ a little
   from it differ more from each other. Of all that cover a representative in some trie, the smallest is its
   cover; being the smallest, it is the same for most of a dense group.
4. By the triangle inequality, a partner of what a cover stands for agrees with the cover itself to an extent that follows from the threshold and
   from how far the cover is from what it stands for.
   In each node, all members are held against all covers of the node's members: a cover with what it stands for and what is so close
   to it is a canopy. Every partner of a covered representative is in its cover's canopy, and canopies don't chain: what is far from a cover
   isn't in its canopy, however many links lead there.
5. Only members of canopies are read again, as sets of shingles. In each canopy, what its cover stands for is verified exactly against all
   members, by products of their incidence matrices. Canopies with more than CELL_ROWS documents or CELL_SHINGLES shingles are dealt into
   blocks, and each pair of blocks is a task; what comes out are counts and a spanning forest, never the pairs.
6. Classes are the components of the verified links.

Words are runs of letters and digits, lower-cased. A text of one to four words is a single shingle: it links to its copies only. Null texts and
such without words link to nothing. A class is named by its smallest doc_id; null doc_ids come last. Rows that repeat a
doc_id are documents of their own. Long texts are signed whole, in blocks of their own. No documents: no rows. Columns besides doc_id and
text are left aside by report(), whatever their names, and kept by keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.llm.components import components
from plandag.llm.shared import drop_table, materialize, row_key, rows_with_keys
from plandag.llm.textkit import U, Block, binary_rows, blocks, grams, mix, per_row, prefix_hash, rows_of, span_hash, whole_groups, word_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 24, 7, 0.9999
#: Sketches that agree in COVERS cover each other, and such that agree in TWINS share a cover; DEVIATIONS is how far a sketch may be off the
#: similarity it stands for.
COVERS, TWINS, DEVIATIONS = 0.4, 0.97, 3.0
#: Members of a node in one task, and documents and shingles of a canopy in one block.
BUCKET_ROWS, CELL_ROWS, CELL_SHINGLES = 1024, 512, 1_000_000
#: Pairs of sketches that are held against each other at once.
PAIRS = 1 << 15


def prefix_length(threshold: float, recall: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in one of the tries with the wanted probability."""
    if not 1 - (1 - threshold) ** TREES >= recall:
        raise ValueError(f"{TREES} tries can't reach a recall of {recall} at a threshold of {threshold}")
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def least_similarity(agreed: np.ndarray, width: int = TREES * DEPTH) -> np.ndarray:
    """The least similarity that sketches which agree so far can stand for, at DEVIATIONS."""
    z = DEVIATIONS**2 / width
    return np.maximum(0.0, (agreed + z / 2 - np.sqrt(z * agreed * (1 - agreed) + z * z / 4)) / (1 + z))


def least_agreement(threshold: float, agreed: np.ndarray, width: int = TREES * DEPTH) -> np.ndarray:
    """The share of its values in which a sketch agrees, at DEVIATIONS, with that of a cover of its partner; agreed: how far the partner's does."""
    z = DEVIATIONS**2 / width
    partner = np.maximum(0.0, threshold - (1 - np.where(agreed >= 1, 1.0, least_similarity(agreed, width))))
    return np.maximum(0.0, partner - np.sqrt(z * partner * (1 - partner)))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n hash functions on 32 bits."""
    a, b = mix(np.arange(1, n + 1, dtype=U)), mix(np.arange(n + 1, 2 * n + 1, dtype=U))
    return (a >> U(32)).astype(np.uint32) | np.uint32(1), (b >> U(32)).astype(np.uint32)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes (with repeats), the bounds of each row's, and two digests of its sequence of words."""
    found = words(block)
    h = word_hashes(block, found)
    n = np.diff(found.first)
    value, at = grams(h, found.row, SHINGLE)
    row = found.row[at]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    digest = np.column_stack([mix(span_hash(prefix_hash(x), found.first[:-1], found.first[1:]) + n.astype(U)) for x in (h, mix(h + U(77)))])
    if len(few):
        value, row = np.concatenate([value, digest[few, 0]]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    return value, np.searchsorted(row, np.arange(len(n) + 1)), digest


def signatures(value: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Minima of n hash functions over each row's shingles. Taken in pieces that stay in the cache."""
    out = np.full((len(bounds) - 1, n), np.uint32(0xFFFFFFFF))
    a, b = multipliers(n)
    x = (value >> U(16)).astype(np.uint32)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + (1 << 14), side="right")) - 1)
        own, part = bounds[first : last + 1] - bounds[first], x[bounds[first] : bounds[last]]
        for k in range(n):
            out[first:last, k] = per_row(np.minimum, part * a[k] + b[k], own, np.uint32(0xFFFFFFFF))
        first = last
    return out


def _sign(short: int):
    """Of each text: digests of its words, a key for each trie of the first `short` values, and the lowest byte of each value, trie by trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch["text"], lower=True):
                value, bounds, digest = shingles(block)
                signature = signatures(value, bounds, TREES * DEPTH)
                keys = np.zeros((len(signature), TREES), U)
                for k in range(short):
                    keys = mix(keys + signature[:, k::DEPTH].astype(U) + U(k + 1))
                keys = mix(keys + np.arange(1, TREES + 1, dtype=U))
                own, n = batch.slice(at, len(signature)), np.diff(bounds)
                at += len(signature)
                sketch = binary_rows((signature & np.uint32(255)).astype(np.uint8))
                columns = [own["doc_id"], own["text_hash"], *(pa.array(digest[:, k].view(np.int64)) for k in (0, 1)), pa.array(n), binary_rows(keys), sketch]
                yield pa.record_batch(columns, ["doc_id", "text_hash", "d1", "d2", "n", "keys", "sketch"])

    return run


SIGNED = "doc_id long, text_hash long, d1 long, d2 long, n long, keys binary, sketch binary"


def _paths(short: int):
    """A row for each trie: the node of the shortest prefix, and the path from there on as a number, a byte a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                node = rows_of(part["keys"], np.int64, TREES)
                below = rows_of(part["sketch"], np.uint8, TREES * DEPTH).reshape(-1, TREES, DEPTH)[:, :, short:]
                path = np.zeros(node.shape, np.int64)
                for k in range(DEPTH - short):
                    path = path << 8 | below[:, :, k]
                yield pa.record_batch([pa.array(node.ravel()), pa.array(path.ravel()), pa.array(np.repeat(part["rep"].to_numpy(), TREES))], ["node", "path", "rep"])

    return run


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal values of each two rows."""
    out = np.empty(len(a))
    for k in range(0, len(a), PAIRS):
        out[k : k + PAIRS] = (a[k : k + PAIRS] == b[k : k + PAIRS]).mean(axis=1)
    return out


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def alike(cell: np.ndarray, rep: np.ndarray, sketch: np.ndarray, members: np.ndarray, least: float, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Members that agree with the smallest one of their cell, and those smallest ones; if not once, the same for what is left, until nothing is."""
    found, by = [members[:0]], [members[:0]]
    while len(members):
        at = heads(cell)
        size = np.diff(np.append(at, len(members)))
        smallest = np.repeat(np.minimum.reduceat(rep[members], at), size)
        pivot = np.repeat(members[rep[members] == smallest], size)
        other = members != pivot
        members, pivot, cell = members[other], pivot[other], cell[other]
        near = agreement(sketch[members], sketch[pivot]) >= least
        found.append(members[near])
        by.append(pivot[near])
        members, cell = members[~near], cell[~near]
        if once:
            break
    return np.concatenate(found), np.concatenate(by)


def cover(cell: np.ndarray, path: np.ndarray, rep: np.ndarray, sketch: np.ndarray, levels: int) -> np.ndarray:
    """The index of what covers each member, or its own. Members are sorted by cell and path; all nodes of a level are taken at once."""
    every = np.arange(len(rep))
    twin = every.copy()
    for level in range(levels):  # matched prefixes get shorter
        left = every[twin == every]
        node = np.zeros(len(left), np.int64)
        node[heads(cell[left], path[left] >> (8 * level))[1:]] = 1
        found, by = alike(np.cumsum(node), rep, sketch, left, TWINS, True)
        twin[found] = by
    for _ in range(levels):  # a twin's twin
        twin = twin[twin]
    left = every[twin == every]
    found, by = alike(cell[left], rep, sketch, left, COVERS, False)
    out = every.copy()
    out[found] = by
    return out[twin]


def _cover(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            rep, sketch = table["rep"].to_numpy(), rows_of(table["sketch"], np.uint8, TREES * DEPTH)
            by = cover(table["cell"].to_numpy(), table["path"].to_numpy(), rep, sketch, levels)
            told = np.flatnonzero(by != np.arange(len(by)))
            agreed = agreement(sketch[told], sketch[by[told]])
            yield pa.record_batch([pa.array(rep[told]), pa.array(rep[by[told]]), pa.array(agreed)], ["rep", "cover", "agreed"])

    return run


def _near(threshold: float):
    """Members of a cell (covers first) that are close enough to a cover that isn't their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cell, member, rep, own = (table[c].to_numpy() for c in ("cell", "member", "rep", "cover"))
            least = least_agreement(threshold, table["agreed"].to_numpy())
            sketch = rows_of(table["sketch"], np.uint8, TREES * DEPTH)
            first = heads(cell)
            end = np.append(first[1:], len(cell))
            middle = np.append(np.cumsum(member == 0), 0)  # so many covers up to here
            covers = middle[end - 1] - middle[first - 1] * (first > 0)
            which = np.flatnonzero(member == 0)
            times = np.repeat(end - first - covers, covers)
            start = np.repeat(first + covers, covers)
            for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(times) // PAIRS)) + 1):
                t = times[part]
                a = np.repeat(which[part], t)
                b = np.repeat(start[part], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                other = own[b] != rep[a]
                a, b = a[other], b[other]
                near = agreement(sketch[a], sketch[b]) >= least[a]
                yield pa.record_batch([pa.array(rep[a[near]]), pa.array(rep[b[near]])], ["canopy", "rep"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for block in blocks(batch["text"], lower=True):
            value, bounds, _ = shingles(block)
            held = [np.unique(value[i:j]).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch["rep"].slice(at, len(held)), pa.array(held, pa.binary())], ["rep", "shingles"])
            at += len(held)


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of chosen sets with others, by products of pieces of the incidence matrix; shingles of one set alone are left out."""
    n = len(sets)
    out = np.zeros((len(rows), len(columns)), np.float32)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    if not len(column):
        return out
    _, column = np.unique(column, return_inverse=True)
    width = max(256, (1 << 22) // n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1, width):
        i, j = np.searchsorted(column, [low, low + width])
        piece = np.zeros((n, min(width, int(column[-1]) + 1 - low)), np.float32)
        piece[row[i:j], column[i:j] - low] = 1
        out += piece[rows] @ piece[columns].T
    return out


def roots(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the first one of its component; linked holds for rows against columns."""
    root = np.arange(n)
    left = np.ones(n, bool)
    row_of, column_of = np.full(n, -1), np.full(n, -1)
    row_of[rows], column_of[columns] = np.arange(len(rows)), np.arange(len(columns))
    for k in range(n):
        if not left[k]:
            continue
        front = np.array([k])
        while len(front):
            left[front] = False
            root[front] = k
            seen = np.zeros(n, bool)
            seen[columns[linked[row_of[front][row_of[front] >= 0]].any(axis=0)]] = True
            seen[rows[linked[:, column_of[front][column_of[front] >= 0]].any(axis=1)]] = True
            front = np.flatnonzero(seen & left)
    return root


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 2000):
            cell = table["cell"].to_numpy()
            first = heads(cell)
            out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
            for at, end in zip(first, np.append(first[1:], len(cell)), strict=True):
                if end == at + 1:
                    continue
                own = table.slice(at, end - at)
                rep, copies = own["rep"].to_numpy(), own["copies"].to_numpy()
                rows, columns = (np.flatnonzero(own[c].to_numpy()) for c in ("chosen", "held"))
                sets = [np.frombuffer(x.as_buffer(), U) for x in own["shingles"]]
                size = np.array([len(s) for s in sets], np.float32)
                both = overlaps(sets, rows, columns)
                linked = both >= threshold * (size[rows][:, None] + size[columns][None, :] - both) - 1e-3
                linked &= rows[:, None] != columns[None, :]
                links = np.zeros(len(rep), np.int64)
                links[rows] = linked @ copies[columns]
                root = roots(linked, rows, columns, len(rep))
                told = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
                out.append((rep[told], rep[root[told]], links[told]))
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["rep", "root", "links"])

    return run


def _block(member: str, n: str, salt: Column) -> Column:
    return F.pmod(F.xxhash64(member, salt), n).cast("int")


def canopies(reps: DataFrame, threshold: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """reps: (rep, keys, sketch). (canopy, rep, chosen): the members of canopies of several, and whether the canopy is that of their cover."""
    short = prefix_length(threshold)
    paths = reps.select("rep", "keys", "sketch").mapInArrow(_paths(short), "node long, path long, rep long")
    shared = materialize(paths.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "nodes")
    met = materialize(paths.join(shared, "node"), "members")
    sketches = reps.select("rep", "sketch")
    blocked = met.withColumn("blocks", F.ceil(F.col("members") / bucket_rows).cast("int"))
    tries = blocked.join(sketches, "rep").select(F.xxhash64("node", _block("rep", "blocks", F.col("node"))).alias("cell"), "path", "rep", "sketch")
    found = tries.repartition("cell").sortWithinPartitions("cell", "path").mapInArrow(_cover(DEPTH - short), "rep long, cover long, agreed double")
    found = materialize(found.groupBy("rep").agg(F.min(F.struct("cover", "agreed")).alias("x")).select("rep", "x.cover", "x.agreed"), "covers")

    own = materialize(met.select("node", "rep").join(found, "rep", "left").select("node", "rep", F.coalesce("cover", "rep").alias("cover")), "covered")
    # Where all members have the same cover, nothing is to be found.
    several = own.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("cover").alias("a"), F.max("cover").alias("b")).where("a <> b").select("node", "members")
    several = materialize(several, "open-nodes")
    covers = materialize(own.join(several, "node").select("node", "cover").distinct(), "node-covers")
    sizes = several.join(covers.groupBy("node").agg(F.count(F.lit(1)).alias("covers")), "node")
    sizes = sizes.select("node", *[F.ceil(F.col(c) / bucket_rows).cast("int").alias(b) for c, b in (("members", "mb"), ("covers", "cb"))])
    block = lambda n: _block("rep", n, F.col("node"))
    side = lambda df, mine, member: df.select(
        F.xxhash64("node", *([block(mine), "other"] if member else ["other", block(mine)])).alias("cell"), F.lit(member).cast("int").alias("member"), "rep", "cover", F.col("agreed") if not member else F.lit(1.0).alias("agreed"), "sketch")
    opened = own.join(sizes, "node").join(sketches, "rep")
    members = side(opened.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cb") - 1))), "mb", True)
    reach = found.groupBy("cover").agg(F.min("agreed").alias("agreed"))  # of what is farthest from it; a cover of itself alone has none
    held = covers.join(reach, "cover", "left").select("node", F.col("cover").alias("rep"), "cover", F.coalesce("agreed", F.lit(1.0)).alias("agreed"))
    held = held.join(sizes, "node").join(sketches, "rep")
    held = side(held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))), "cb", False)
    near = members.unionAll(held).repartition("cell").sortWithinPartitions("cell", "member").mapInArrow(_near(threshold), "canopy long, rep long")
    loose = near.distinct().select("canopy", "rep", F.lit(False).alias("chosen"))
    every = materialize(own.select(F.col("cover").alias("canopy"), "rep", F.lit(True).alias("chosen")).distinct().unionAll(loose), "canopies")
    many = every.groupBy("canopy").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("canopy")
    out = materialize(every.join(many, "canopy"), "canopy-members")
    for done in (shared, met, found, own, several, covers, every):
        drop_table(done)
    return out


def verified(texts: DataFrame, reps: DataFrame, member: DataFrame, threshold: float, cell_rows: int, cell_shingles: int) -> DataFrame:
    """(rep, root, links): rows of the same rep are to be summed up, and connected by their roots."""
    wanted = member.select("rep").distinct().join(reps.select("rep", "rep_doc", "rep_hash"), "rep")
    same = texts["doc_id"].eqNullSafe(wanted["rep_doc"]) & (texts["text_hash"] == wanted["rep_hash"])
    # Rows of equal doc_id and text are read more than once.
    sets = texts.join(wanted, same).select("rep", "text").mapInArrow(_sets, "rep long, shingles binary").groupBy("rep").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "shingle-sets")
    sized = member.join(reps.select("rep", "n", "copies"), "rep")
    need = lambda which: F.greatest(F.ceil(F.sum(F.when(which, F.col("n"))) / cell_shingles), F.ceil(F.count_if(which) / cell_rows), F.lit(1)).cast("int")
    parts = sized.groupBy("canopy").agg(need(F.col("chosen")).alias("cb"), need(F.lit(True)).alias("hb"))
    placed = sized.drop("n").join(parts, "canopy").withColumns({"c": _block("rep", "cb", F.lit(1)), "h": _block("rep", "hb", F.lit(2))})
    # As held against: with all blocks of the chosen ones. As chosen: with all blocks, the one where it is held against is that row already.
    held = F.transform(F.sequence(F.lit(0), F.col("cb") - 1), lambda i: F.struct(i.alias("i"), F.col("h").alias("j"), (F.col("chosen") & (i == F.col("c"))).alias("chosen"), F.lit(True).alias("held")))
    chosen = F.transform(F.filter(F.sequence(F.lit(0), F.col("hb") - 1), lambda j: F.col("chosen") & (j != F.col("h"))), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(True).alias("chosen"), F.lit(False).alias("held")))
    cells = placed.select("canopy", "rep", "copies", F.explode(F.concat(held, chosen)).alias("x"))
    cells = cells.select(F.xxhash64("canopy", "x.i", "x.j").alias("cell"), "rep", "copies", "x.chosen", "x.held").join(sets, "rep")
    checked = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(threshold), "rep long, root long, links long")
    checked = materialize(checked, "verified")
    drop_table(sets)
    return checked


def report(
    docs: DataFrame, threshold: float = THRESHOLD, bucket_rows: int = BUCKET_ROWS, cell_rows: int = CELL_ROWS, cell_shingles: int = CELL_SHINGLES
) -> DataFrame:
    """A row for each document: doc_id, class_id, n_links (other documents at the threshold or above, copies included), class_size, keeper, text_hash.

    keeper: this document, or a row with the same doc_id and text, stands for the class.
    """
    short = prefix_length(threshold)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(texts.mapInArrow(_sign(short), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signatures")
    named = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    reps = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(named).alias("name"))
    rows = signed.select(F.col("row").alias("rep"), F.col("doc_id").alias("rep_doc"), F.col("text_hash").alias("rep_hash"), "n", "keys", "sketch")
    reps = materialize(reps.join(rows, "rep"), "representatives")

    member = canopies(reps, threshold, bucket_rows)
    checked = verified(texts, reps, member, threshold, cell_rows, cell_shingles)
    drop_table(member)
    counts = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("rep"), F.col("b").alias("root"))
    found = reps.select("d1", "d2", "rep", "copies", "name").join(counts, "rep", "left").join(joined, "rep", "left")
    found = found.withColumns({"root": F.coalesce("root", "rep"), "links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1})
    found = materialize(found, "classes")
    for done in (checked, joined, reps):
        drop_table(done)
    classes = found.groupBy("root").agg(F.min("name").alias("first"), F.sum("copies").alias("class_size"))
    told = found.select("d1", "d2", "links", "root").join(classes, "root").drop("root")
    out = signed.where("n > 0").select("doc_id", "text_hash", "d1", "d2").join(told, ["d1", "d2"])
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    out = out.select("doc_id", F.col("first.doc_id").alias("class_id"), F.col("links").alias("n_links"), "class_size", keeper.alias("keeper"), "text_hash")
    alone = signed.where("n = 0")
    long = lambda x: F.lit(x).cast("long")
    return out.unionAll(alone.select("doc_id", F.col("doc_id").alias("class_id"), long(0).alias("n_links"), long(1).alias("class_size"), F.lit(True).alias("keeper"), "text_hash"))


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """A document of each class, the one with the smallest doc_id, with all its columns."""
    kept = report(docs, **options).where("keeper").select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key"))
    text = F.coalesce(docs["text"], F.lit(""))
    # Rows of equal doc_id and text are one document; such without words link to nothing, so all of them stay.
    with_words = F.regexp_like(text, F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    return rows_with_keys(docs, row_key(docs["doc_id"], F.xxhash64(text)), kept, with_words)
