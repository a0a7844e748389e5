"""Whole batches of texts as byte arrays: words, their hashes and shingles, without a Python step for each word.

Hashes are polynomials modulo 2**64 over prefix sums, finished by a mixing function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
#: Digits, ASCII letters, and all bytes of characters outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int, way: str = "up") -> np.ndarray:
    """BASE to the powers 0 to n - 1; down: of its inverse. Kept while small."""
    if len(_powers[way]) < n:
        size = max(n, 2 * BLOCK + 1)
        made = np.full(size, BASE if way == "up" else BASE_INVERSE, U)
        made[0] = 1
        made = np.cumprod(made, dtype=U)
        if size > 8 * BLOCK:
            return made[:n]
        _powers[way] = made
    return _powers[way][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (values[k] + 1) * BASE**k over i <= k < j."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers(len(values)), dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same for equal spans wherever they stand. Not mixed."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), "down")[start]


@dataclass
class Block:
    """Rows first to last of a batch: their bytes, and where each row's begin and end."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK, lower: bool = False) -> Iterator[Block]:
    """Null counts as empty. Of a batch, only a block at a time is copied and lower-cased."""
    first = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(chunk), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
            own = pc.fill_null(chunk.slice(i, j - i).cast(pa.large_string()), "")
            if lower:
                own = pc.utf8_lower(own)
            _, offsets, data = own.buffers()
            offsets = np.frombuffer(offsets, np.int64)[own.offset : own.offset + j - i + 1]
            data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
            yield Block(first + i, data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
            i = j
        first += len(chunk)


@dataclass
class Words:
    """start, end: bytes; row: index in the block; first: for each row, the index of its first word, and a last entry."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(block: Block, table: np.ndarray = WORD) -> Words:
    """Runs of the table's bytes, broken at the ends of rows."""
    inside = table[block.data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    full = block.ends > block.starts
    if len(inside):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[block.starts[full]] = False
        after[block.ends[full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, np.append(block.starts, len(block.data)))
    return Words(start, end, np.repeat(np.arange(len(block.starts)), np.diff(first)), first)


def word_hashes(block: Block, found: Words, piece: int = 2 * BLOCK) -> np.ndarray:
    """In pieces of a text, so that a long one needs no prefix sums of its whole length; a word's hash doesn't depend on where it stands."""
    if len(block.data) <= piece:
        return mix(span_hash(prefix_hash(block.data), found.start, found.end))
    out, i = np.empty(len(found.start), U), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(found.end, found.start[i] + piece, side="right")))
        zero = found.start[i]
        out[i:j] = span_hash(prefix_hash(block.data[zero : found.end[j - 1]]), found.start[i:j] - zero, found.end[i:j] - zero)
        i = j
    return mix(out)


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within a text, and the index of their first words."""
    if len(hashes) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    out = np.zeros(size, U)
    for k in range(n):
        out = out * BASE + hashes[k : k + size]
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    return mix(out[at]), at


def per_row(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: object) -> np.ndarray:
    """ufunc.reduceat for rows that may be empty. bounds: one more than rows."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000, size: int = 1 << 24) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key; a table ends once it has so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    n, nbytes, factor = 0, 0, 1
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
            held.append(part)
            n, nbytes = n + part.num_rows, nbytes + part.nbytes
            if n < factor * rows and nbytes < factor * size:
                continue
            table = pa.Table.from_batches(held)
            last = pc.index(table[key], table[key][-1]).as_py()  # where the last group begins
            if last:
                yield table.slice(0, last)
            # One large group: look again when there is as much once more.
            factor = 1 if last else 2 * factor
            held = table.slice(last).combine_chunks().to_batches()
            n, nbytes = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if n:
        yield pa.Table.from_batches(held)


def binary_rows(values: np.ndarray) -> pa.Array:
    """A binary value for each row of a contiguous two-dimensional array."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * values.shape[1]
    offsets = np.arange(len(values) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def rows_of(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    """The array that binary_rows() was given."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)
