"""Vectorised code-point kernels for Arrow batches (used by T6/T7 and E2).

A batch of strings is decoded once into one flat ``uint32`` array of code
points plus row offsets; counting and vocabulary lookup are then single
numpy calls over the whole batch (no Python loop per row or character).
Spaces are dropped, matching ``char_array`` (trim, remove ' ', split).
NULL strings are treated as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20
BMP = 0x10000
# A slice's text bytes (>= its code points): bounds the arrays of one slice,
# whose offsets are 32-bit numbers. A longer text is a slice of its own.
SLICE_BYTES = 1 << 19


def slices(batch: pa.RecordBatch, cols: list[str],
           limit: int = SLICE_BYTES):
    """Cut ``batch`` into row slices whose text columns hold at most
    ``limit`` bytes (a single longer row is its own slice)."""
    n = batch.num_rows
    if n == 0:
        yield batch
        return
    size = np.zeros(n, np.int64)
    for c in cols:
        a = batch.column(c)
        size += pc.binary_length(a).fill_null(0).to_numpy(
            zero_copy_only=False).astype(np.int64)
    if size.sum() <= limit:
        yield batch
        return
    cum = np.cumsum(size)
    start = 0
    while start < n:
        base = cum[start - 1] if start else 0
        end = int(np.searchsorted(cum, base + limit, side="right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def all_code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cps, offsets): code points of every row, and row offsets into
    ``cps`` (length ``len(arr) + 1``)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    large = pa.types.is_large_string(arr.type)
    boffs = np.frombuffer(arr.buffers()[1], np.int64 if large else np.int32)[
        arr.offset:arr.offset + n + 1]
    data = arr.buffers()[2]
    first, last = int(boffs[0]), int(boffs[-1])
    raw = b"" if data is None else data.slice(first, last - first).to_pybytes()
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lens = pc.utf8_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.zeros(n + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    return cps, offs


def code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``all_code_points``, without spaces."""
    cps, offs = all_code_points(arr)
    keep = cps != SPACE
    cum = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=cum[1:])
    return cps[keep], cum[offs]


class CountAccumulator:
    """Counts code points over many batches: a dense count table for the
    basic plane, ``np.unique`` for the rest."""

    def __init__(self) -> None:
        self.bmp = np.zeros(BMP, np.int64)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, cps: np.ndarray) -> None:
        low = cps < BMP
        self.bmp += np.bincount(cps[low], minlength=BMP)
        if not low.all():
            self.rest.append(np.unique(cps[~low], return_counts=True))
            if len(self.rest) > 64:
                self.rest = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([r[0] for r in self.rest]),
                               return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        np.add.at(out, back, np.concatenate([r[1] for r in self.rest]))
        return keys, out

    def batch(self) -> pa.RecordBatch:
        keys = np.nonzero(self.bmp)[0]
        vals = self.bmp[keys]
        if self.rest:
            more, counts = self._merged()
            keys = np.concatenate([keys, more])
            vals = np.concatenate([vals, counts])
        chars = "".join(map(chr, keys.tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(chars), pa.string()), pa.array(vals, pa.int64())],
            names=["ch", "n"])


class Lookup:
    """Character -> id table (single-character tokens only); misses map to
    ``default``. Basic-plane characters index a dense 64 K table, others
    are found with ``np.searchsorted``."""

    def __init__(self, mapping: dict[str, int], default: int) -> None:
        items = sorted((ord(k), v) for k, v in mapping.items() if len(k) == 1)
        self.keys = np.array([k for k, _ in items], np.uint32)
        self.vals = np.array([v for _, v in items], np.int32)
        self.default = np.int32(default)
        self.dense = np.full(BMP, self.default, np.int32)
        low = self.keys < BMP
        self.dense[self.keys[low]] = self.vals[low]

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        low = cps < BMP
        out = self.dense[np.where(low, cps, 0)]
        if not low.all():
            hi = np.nonzero(~low)[0]
            c = cps[hi]
            if len(self.keys):
                i = np.minimum(np.searchsorted(self.keys, c), len(self.keys) - 1)
                out[hi] = np.where(self.keys[i] == c, self.vals[i], self.default)
            else:
                out[hi] = self.default
        return out


def frame(segments: list[tuple[np.ndarray, np.ndarray]], cls_id: int,
          sep_id: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Assemble ``[CLS] a [SEP] (b [SEP])`` per row from id segments given
    as (ids, offsets). Returns (input_ids, token_type_ids, length)."""
    n = len(segments[0][1]) - 1
    lens = [np.diff(o) for _, o in segments]
    # row layout: CLS, seg0, SEP, then for each further segment: seg, SEP
    total_per_row = 1 + sum(ln + 1 for ln in lens)
    out_offs = np.zeros(n + 1, np.int64)
    np.cumsum(total_per_row, out=out_offs[1:])
    ids = np.empty(out_offs[-1], np.int32)
    types = np.zeros(out_offs[-1], np.int32)
    ids[out_offs[:-1]] = cls_id
    start = out_offs[:-1] + 1
    for k, ((seg_ids, seg_offs), ln) in enumerate(zip(segments, lens)):
        # element j of row r lands at j + (start[r] - seg_offs[r])
        pos = np.arange(len(seg_ids)) + np.repeat(start - seg_offs[:-1], ln)
        ids[pos] = seg_ids
        sep_pos = start + ln
        ids[sep_pos] = sep_id
        if k > 0:
            types[pos] = 1
            types[sep_pos] = 1
        start = sep_pos + 1
    off32 = pa.array(out_offs.astype(np.int32), pa.int32())
    return (pa.ListArray.from_arrays(off32, pa.array(ids, pa.int32())),
            pa.ListArray.from_arrays(off32, pa.array(types, pa.int32())),
            pa.array(total_per_row.astype(np.int32), pa.int32()))
