"""Characters replaced by descriptions, whole Arrow columns at once.

The UTF-8 bytes of a column are one buffer. Bytes that start a character of
the lexicon are found by a table of 256 first bytes, only those characters
are decoded and looked up, and the result is put together with two scatters:
bytes that stay, and the descriptions. Work follows the bytes, not the rows
or the lexicon.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 22      # a longer text is a slice of its own


class Lexicon:
    """Single characters and what replaces them; other keys match nothing."""

    def __init__(self, names: Mapping[str, str]):
        items = sorted((ord(k), v.encode()) for k, v in names.items()
                       if len(k) == 1)
        self.keys = np.array([k for k, _ in items], np.int64)
        self.size = np.array([len(v) for _, v in items], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.frombuffer(b"".join(v for _, v in items), np.uint8)
        self.first = np.zeros(256, bool)
        self.first[[chr(k).encode("utf-8", "surrogatepass")[0]
                    for k in self.keys.tolist()]] = True

    def _hits(self, raw: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a character of the lexicon starts, its bytes, its key."""
        at = np.flatnonzero(self.first[raw])
        lead = raw[at].astype(np.int64)
        n = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        code = np.where(n == 1, lead, lead & (0xFF >> (n + 1)))
        for k in (1, 2, 3):
            more = raw[np.minimum(at + k, len(raw) - 1)] & 0x3F
            code = np.where(n > k, (code << 6) | more, code)
        key = np.minimum(np.searchsorted(self.keys, code),
                         len(self.keys) - 1)
        hit = self.keys[key] == code
        return at[hit], n[hit], key[hit]

    def _replaced(self, raw: np.ndarray, off: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
        at, n, key = self._hits(raw)
        if not len(at):
            return raw, off
        size = self.size[key]
        moved = np.concatenate([[0], np.cumsum(size - n)])
        out = np.empty(len(raw) + moved[-1], np.uint8)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size,
                                                   size)
        place = np.repeat(at + moved[:-1], size) + within
        stays = np.ones(len(out), bool)
        stays[place] = False
        kept = np.ones(len(raw), bool)
        for k in range(4):
            kept[at[n > k] + k] = False
        out[stays] = raw[kept]
        out[place] = self.text[np.repeat(self.start[key], size) + within]
        return out, off + moved[np.searchsorted(at, off)]

    def __call__(self, column: pa.Array) -> pa.Array:
        if not len(self.keys) or not len(column):
            return column
        texts = column.cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[
            texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and \
            data.size else np.zeros(0, np.uint8)
        parts, a = [], 0
        while a < len(texts):
            z = int(np.searchsorted(off, off[a] + SLICE_BYTES,
                                    side="right")) - 1
            z = min(max(z, a + 1), len(texts))
            own, cut = self._replaced(raw[off[a]:off[z]],
                                      off[a:z + 1] - off[a])
            parts.append(pa.LargeStringArray.from_buffers(
                z - a, pa.py_buffer(cut.astype(np.int64)),
                pa.py_buffer(np.ascontiguousarray(own))))
            a = z
        out = pa.concat_arrays(parts)
        if texts.null_count:
            import pyarrow.compute as pc
            out = pc.if_else(texts.is_valid(), out, None)
        return out.cast(column.type)
