"""Whole batches of texts as flat numpy arrays: words, hashes and shingles without a loop per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Words longer than this are hashed one by one, so that one endless word costs one call.
LONG_WORD = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of values that start at `first`, one after another."""
    end = np.cumsum(size)
    if not len(end) or not end[-1]:
        return values[:0]
    return values[np.repeat(first - (end - size), size) + np.arange(end[-1])]


#: Bytes of text that a task looks at in one go.
SLICE = 4 << 20


def sliced(batches, column: int = 0, most: int | None = None):
    """The batches in parts of about `most` bytes of their texts in that column; a longer text is a part of its own."""
    most = most or SLICE
    for b in batches:
        end = np.cumsum(np.diff(text_bytes(b.column(column))[1]))
        part = end // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield b.slice(a, z - a)


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it belongs to."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~BLANK[raw]
    first, last = word.copy(), word.copy()
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a time."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * M1 + np.uint64(1))
    if not len(starts):
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(raw) + 1,), strides=(1,))
    rows, at = np.arange(len(starts)), 0
    long = np.flatnonzero(size > LONG_WORD)
    rows = rows[size <= LONG_WORD] if len(long) else rows
    while len(rows):
        left = size[rows] - at
        v = eights[starts[rows] + at]
        short = left < 8
        if short.any():
            v[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[rows] = mix((h[rows] ^ v) * M1)
        at += 8
        rows = rows[left > 8]
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row, and their rows.

    A row of fewer words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    n = len(words)
    odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3) | 1) & (2**64 - 1)) for j in range(size)]
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total += words[j : n - size + 1 + j] * odd[j]
        whole = row[: n - size + 1] == row[size - 1 :]
        full, full_row = mix(total[whole]), row[: n - size + 1][whole]
    else:
        full, full_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        first = np.concatenate([[0], np.cumsum(counts)])
        short = np.zeros(len(few), np.uint64)
        for j in range(size - 1):
            has = counts[few] > j
            short[has] += words[first[few[has]] + j] * odd[j]
        full = np.concatenate([full, mix(short + counts[few].astype(np.uint64))])
        full_row = np.concatenate([full_row, few])
    return full, full_row


def distinct_sorted(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted within each row, repeats removed."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    if len(v):
        keep = np.ones(len(v), bool)
        keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        v, r = v[keep], r[keep]
    return v, r
