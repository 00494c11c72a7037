"""Batch token encoding: each distinct chunk of text is encoded once.

The pre-tokenisers used here never let a token cross from a character that
isn't white space to a white space character, so a text may be cut there and
the encodings of its parts joined. Chunks (white space and the word after it)
repeat often; a task keeps the encodings of those it has seen, found by a
64-bit hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from tasklane.llm import kernel as K

CACHE_ENTRIES = 1 << 19
KEPT_ENTRIES = 1 << 20     # of an encoder that outlives its task
SLICE_BYTES = 1 << 20
ENCODE_TEXTS = 4096        # strings given to the tokenizer at once
JOIN = 64                  # chunks in one of them


def chunk_spans(buf: np.ndarray, off: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut before ASCII white space that follows another character. Where
    that character could be white space outside ASCII nothing is cut."""
    cut = K.SPACE[buf]
    cut[1:] &= ~K.SPACE[buf[:-1]]
    wide = np.flatnonzero(cut)
    wide = wide[wide > 0]
    wide = wide[buf[wide - 1] >= 0x80]
    two, three = buf[wide - 2], buf[np.maximum(wide, 3) - 3]
    cut[wide[(two == 0xC2) | (three == 0xE1) | (three == 0xE2)
             | (three == 0xE3)]] = False
    cut[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(
        starts, off)


class ChunkEncoder:
    """Encodings of chunks, kept. ``encode_many``: a list of strings -> their
    id lists. ``widths``: the bytes that each id stands for, where ids spell
    the text byte by byte; then new chunks are encoded ``JOIN`` at a time,
    as one string, and told apart by their bytes. ``entries``: how many chunks
    are kept."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]],
                 widths: np.ndarray | None = None,
                 entries: int = CACHE_ENTRIES):
        self.encode_many = encode_many
        self.widths = widths
        self.entries = entries
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        sizes, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(texts), ENCODE_TEXTS):
            found = self.encode_many([t.decode()
                                      for t in texts[a:a + ENCODE_TEXTS]])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts += [np.array(x, np.uint32) for x in found]
        return np.concatenate(sizes), np.concatenate(parts)

    def _joined(self, texts: list[bytes]
                ) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_encoded``; None where the ids don't spell the texts."""
        size, ids = self._encoded([b"".join(texts[a:a + JOIN])
                                   for a in range(0, len(texts), JOIN)])
        spelt = np.concatenate([[0], np.cumsum(self.widths[ids])])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        at = np.searchsorted(spelt, ends)
        if at[-1] >= len(spelt) or (spelt[at] != ends).any():
            return None
        return np.diff(at, prepend=0), ids

    def _learn(self, at: np.ndarray, hashes: np.ndarray, texts: list[bytes],
               alone: np.ndarray) -> None:
        """Put new chunks at their sorted places. ``alone``: those that
        can't be joined with others."""
        size = np.zeros(len(texts), np.int64)
        start = np.zeros(len(texts), np.int64)
        base = len(self.store)
        together = np.flatnonzero(~alone)
        found = self._joined([texts[i] for i in together]) if len(
            together) else None
        done = [self.store]
        for rows, (n, ids) in ([(together, found)] if found else []):
            size[rows], start[rows] = n, base + np.cumsum(n) - n
            done.append(ids)
            base += len(ids)
        rest = np.flatnonzero(alone) if found else np.arange(len(texts))
        n, ids = self._encoded([texts[i] for i in rest])
        size[rest], start[rest] = n, base + np.cumsum(n) - n
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, start)
        self.size = np.insert(self.size, at, size)
        self.store = np.concatenate([*done, ids])

    def _alone(self, buf, starts, ends) -> np.ndarray:
        """Chunks that don't start with white space or may end with it."""
        if self.widths is None:
            return np.ones(len(starts), bool)
        end, two, three = (buf[np.maximum(ends - k, 0)] for k in (1, 2, 3))
        wide = (two == 0xC2) | (three == 0xE1) | (three == 0xE2) | (
            three == 0xE3)
        return ~K.SPACE[buf[starts]] | K.SPACE[end] | (end >= 0x80) & wide

    def _slots(self, buf, starts, ends):
        h = K.span_hashes(buf, starts, ends)
        each, first, back = np.unique(h, return_index=True,
                                      return_inverse=True)
        if len(self.known) + len(each) > self.entries:
            self._clear()
        at = np.searchsorted(self.known, each)
        new = np.ones(len(each), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != each[inside]
        if new.any():
            data = memoryview(buf)
            a, b = starts[first[new]], ends[first[new]]
            self._learn(at[new], each[new], [
                bytes(data[x:y]) for x, y in zip(a.tolist(), b.tolist(),
                                                 strict=True)],
                self._alone(buf, a, b))
            at = np.searchsorted(self.known, each)
        return at[back]

    def lengths(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Ids of each row's text, counted."""
        if not len(buf):
            return np.zeros(len(off) - 1, np.int64)
        starts, ends, ptr = chunk_spans(buf, off)
        slot = self._slots(buf, starts, ends)     # may replace the arrays
        return K.sums(self.size[slot], ptr[:-1], ptr[1:])

    def encode(self, buf: np.ndarray, off: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """All ids in sequence, and the n+1 row offsets into them."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts, ends, ptr = chunk_spans(buf, off)
        slot = self._slots(buf, starts, ends)
        size = self.size[slot]
        edge = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[slot] - edge[:-1], size) + np.arange(
            edge[-1])
        return self.store[at], edge[ptr]


def bpe_ranks(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A vocabulary of ranked byte strings, by the tiktoken library; special
    tokens' strings are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b)
                 for a, b in (line.split() for line in f if line.strip())}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [own.encode_ordinary(t) for t in texts]


def bpe_json(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A tokenizer file of the tokenizers library."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in own.encode_batch_fast(
        texts, add_special_tokens=False)]


def json_encoder(path: str, entries: int = CACHE_ENTRIES) -> ChunkEncoder:
    """For a tokenizer file of the tokenizers library. The ids of byte-level
    pairs spell a text: each character of a token stands for one byte."""
    import json
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    plain = own.get("normalizer") is None and own["model"][
        "type"] == "BPE" and (own.get("pre_tokenizer") or {}).get(
            "type") == "ByteLevel" and not own["pre_tokenizer"].get(
                "add_prefix_space")
    if not plain:
        return ChunkEncoder(bpe_json(path), entries=entries)
    names = own["model"]["vocab"] | {
        t["content"]: t["id"] for t in own.get("added_tokens", ())}
    widths = np.zeros(max(names.values()) + 1, np.int64)
    for name, i in names.items():
        widths[i] = len(name)
    return ChunkEncoder(bpe_json(path), widths, entries)


@lru_cache(maxsize=1)
def installed_encoder(name: str) -> ChunkEncoder:
    """For an installed vocabulary; a worker's later tasks find what earlier
    ones loaded and encoded."""
    return json_encoder(vocabulary(name), KEPT_ENTRIES)


def vocabulary(name: str) -> str:
    """Where an installed public vocabulary file is."""
    import public_tokenizers
    return str(public_tokenizers.path(name))
