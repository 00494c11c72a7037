"""Vectorised text kernel shared by the operators that run in Arrow batches.

A string column becomes one byte buffer and row offsets; words, lines and
their 64-bit hashes are found with whole-buffer numpy passes. Words are runs
of bytes outside ``\\x20 \\x09-\\x0D``; those separators are ASCII, so byte
boundaries are code point boundaries. Nulls count as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
STRIDE = 1 << 17           # bytes hashed by one running sum

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MUL = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
_U = np.uint64


def byte_slices(batches: Iterator[pa.RecordBatch], column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each;
    a longer text makes a slice of its own. No row is split or lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False)
                         .astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + limit, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in sequence, and the n+1 row offsets into them."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size \
        else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n+1 offsets of each row's
    words in those arrays. ``between``: the 256-entry table of separators."""
    if not buf.size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~between[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < off[1:]]
    first[at] = inside[at]
    at = off[1:][off[:-1] < off[1:]] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def rows_of(ptr: np.ndarray) -> np.ndarray:
    """Row number of each item, from the n+1 item offsets."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray
         ) -> np.ndarray:
    """Integer sums of ``values[start:stop]`` per row; empty ranges are 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=total[1:])
    return total[np.maximum(stop, start)] - total[start]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for two strides."""
    out = []
    for base in (_MUL, pow(_MUL, -1, 1 << 64)):
        run = np.full(2 * STRIDE, base, _U)
        run[0] = 1
        out.append(np.cumprod(run, dtype=_U))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _polynomial(data: np.ndarray, up: np.ndarray) -> int:
    """A long span's polynomial, stride by stride."""
    total, scale = 0, 1
    jump = pow(_MUL, STRIDE, 1 << 64)
    for a in range(0, len(data), STRIDE):
        part = data[a:a + STRIDE].astype(_U) + _U(1)
        part *= up[:len(part)]
        total += int(part.sum(dtype=_U)) * scale
        scale = scale * jump % (1 << 64)
    return total % (1 << 64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray
                ) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial in the bytes, taken from
    running sums, then finalised with the length. A sum covers a stride of
    the buffer and the spans that start in it, so what this needs beside the
    spans is the same for a buffer of any length; a longer span has sums of
    its own."""
    if len(starts) and (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        out = np.empty(len(starts), _U)
        out[order] = span_hashes(buf, starts[order], ends[order])
        return out
    up, down = _powers()
    value = np.zeros(len(starts), _U)
    size = ends - starts
    edge = np.searchsorted(starts, np.arange(0, len(buf) + STRIDE, STRIDE))
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if a == z:
            continue
        small = a + np.flatnonzero(size[a:z] <= STRIDE)
        if len(small):
            base = int(starts[small[0]])
            part = buf[base:int(ends[small].max())].astype(_U)
            part += _U(1)
            part *= up[:len(part)]
            run = np.zeros(len(part) + 1, _U)
            np.cumsum(part, dtype=_U, out=run[1:])
            value[small] = (run[ends[small] - base]
                            - run[starts[small] - base]
                            ) * down[starts[small] - base]
    for i in np.flatnonzero(size > STRIDE).tolist():
        value[i] = _polynomial(buf[starts[i]:ends[i]], up)
    return mix(value ^ (size.astype(_U) * _U(0xD6E8FEB86659FD93)))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word hashes (row borders ignored)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, _U)
    for k in range(n):
        out = out * _U(0xC2B2AE3D27D4EB4F) + words[k:k + count]
    return mix(out)


def windows(ptr: np.ndarray, n: int) -> np.ndarray:
    """Start positions of the ``n``-item windows that lie within one row."""
    size = np.maximum(np.diff(ptr) - n + 1, 0)
    first = np.repeat(ptr[:-1] - np.concatenate(
        [[0], np.cumsum(size)[:-1]]), size)
    return first + np.arange(size.sum())


def with_columns(batch: pa.RecordBatch, keep: list[str],
                 new: dict[str, pa.Array], schema: pa.Schema
                 ) -> pa.RecordBatch:
    """The kept columns of ``batch`` and new ones, in ``schema``."""
    arrays = [batch.column(c) for c in keep] + list(new.values())
    return pa.RecordBatch.from_arrays(
        [a.cast(f.type) for a, f in zip(arrays, schema, strict=True)],
        schema=schema)
