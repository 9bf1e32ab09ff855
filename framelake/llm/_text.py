"""Vectorised passes over the texts of an Arrow batch: bytes, words and their hashes, in numpy.

A text is UTF-8 bytes; null counts as empty. Hashes are polynomials modulo 2^64 taken from prefix sums,
so the hash of any slice costs two look-ups and a product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n, kept for the next call."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the start of each row's (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21, each: int = 64) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a part's texts have about `most` bytes, if a text counts `each` more than it has; a longer text is a part of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths + each) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def prefix(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of data[t] * BASE^t for i <= t < j."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def slices(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes within a row, and how many rows' words come before (one more than rows)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = spaces(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    start = np.flatnonzero(~space & (before | cut[:-1]))
    end = np.flatnonzero(~space & (after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def row_of(counts_before: np.ndarray) -> np.ndarray:
    """The row of each item, from the items before each row."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start..start+length of all slices, one after the other."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.arange(total) - np.repeat(first - start, length)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of k-word shingles of each row as 64-bit hashes: (hashes sorted within rows, items before each row, how often the row has each).

    A row of 1 to k-1 words has one shingle of all its words; a row without words has none."""
    start, end, before = words(data, offsets)
    h = slices(prefix(data), start, end)
    n = len(h)
    row, total = row_of(before), np.zeros(n, U)
    left = np.repeat(before[1:], np.diff(before)) - np.arange(n)  # words from here to the row's end
    for i in range(k):
        there = np.zeros(n, U)
        there[: n - i] = h[i:] if i else h
        np.add(total, np.where(left > i, there, U(0)) * U(pow(BASE, i + 1, 1 << 64)), out=total)
    first = np.zeros(n, bool)
    first[before[:-1][np.diff(before) > 0]] = True
    keep = (left >= k) | first
    got, row = mix(total[keep]), row[keep]
    order = np.lexsort((got, row))
    got, row = got[order], row[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(got)))
    got, row = got[new], row[new]
    return got, np.searchsorted(row, np.arange(len(offsets))), count


def numbered(items: np.ndarray, before: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: an item that a row has thrice becomes three. (Items, items before each row.)"""
    which = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    many = mix(np.repeat(items, count) + which.astype(U) * U(0xA0761D6478BD642F))
    return many, np.concatenate([[0], np.cumsum(count)])[before]
