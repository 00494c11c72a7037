"""Words and greedy longest-match pieces over Arrow batches (E2, sub-words).

Text is cut as usual for a vocabulary of characters and word pieces: white
space separates words, punctuation and CJK characters are words alone,
control characters vanish. A word becomes the longest token that starts it,
then the longest continuation token at each place reached; a word that can't
be spelt to its end is unknown as a whole.

Tokens form two tries (starts and continuations) over code points, kept as
sorted arrays of (node, code point) and child. All distinct words of a batch
walk them at once, a code point at a step.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_SPLIT, _ALONE, _GONE, _PLAIN, _UNASSIGNED = range(5)

# Ranges of code points that are words alone.
CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF),
       (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
       (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
ASCII_SYMBOLS = "$+<=>^`|~"

_SHIFT = 21                # a code point's bits


def _class(cp: int) -> int:
    ch = chr(cp)
    if ch in " \t\n\r":
        return _SPLIT
    kind = unicodedata.category(ch)
    if kind[0] == "Z":
        return _SPLIT
    if kind == "Cn" and cp != 0xFFFD:
        return _UNASSIGNED
    if kind[0] == "C" or cp == 0xFFFD:
        return _GONE
    if kind[0] == "P" or ch in ASCII_SYMBOLS or any(
            a <= cp <= b for a, b in CJK):
        return _ALONE
    return _PLAIN


_KINDS = np.full(0x110000, -1, np.int8)      # of the code points seen


def _kinds(cps: np.ndarray) -> np.ndarray:
    kind = _KINDS[cps]
    new = kind < 0
    if new.any():
        each = np.unique(cps[new])
        _KINDS[each] = [_class(c) for c in each.tolist()]
        kind = _KINDS[cps]
    return kind


def words(cps: np.ndarray, offsets: np.ndarray, unassigned: bool = False
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points without control characters, start and end of each word in
    them, and the n+1 offsets of each row's words. ``unassigned``: code points
    without a character stay, as parts of words."""
    kind = _kinds(cps)
    keep = kind != _GONE
    if not unassigned:
        keep &= kind != _UNASSIGNED
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    cps, kind = cps[keep], kind[keep]
    inside = kind != _SPLIT
    alone = kind == _ALONE
    first = inside.copy()
    first[1:] &= ~inside[:-1] | alone[1:] | alone[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | alone[1:] | alone[:-1]
    edge = at[1:][at[:-1] < at[1:]] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return cps, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of all runs, one run after the other."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - first, size)


def distinct(cps: np.ndarray, start: np.ndarray, end: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each distinct word, and which of these each word is.
    Found by a 64-bit hash and compared; on a clash all words stay apart."""
    size = end - start
    if not len(size):
        none = np.zeros(0, np.int64)
        return none, none
    at = _flat(start, size)
    own = cps[at]
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    np.multiply.accumulate(power, out=power)
    first = np.cumsum(size) - size
    h = np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * power[
        np.arange(len(at)) - np.repeat(first, size)], first)
    h ^= h >> np.uint64(29)
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    like = one[back]
    if (size[like] != size).any() or (
            cps[at + np.repeat(start[like] - start, size)] != own).any():
        return np.arange(len(size)), np.arange(len(size))
    return one, back


def counted_words(cps: np.ndarray, offsets: np.ndarray):
    """(word, n) of all rows together; a word may come more than once."""
    cps, start, end, _ = words(cps, offsets, unassigned=True)
    one, back = distinct(cps, start, end)
    text = cps.astype("<u4").tobytes().decode("utf-32-le")
    return zip([text[a:b] for a, b in zip(start[one].tolist(),
                                          end[one].tolist(), strict=True)],
               np.bincount(back, minlength=len(one)).tolist(), strict=True)


class Pieces:
    """A vocabulary's tries. ``tokens``: text -> id; those with the
    ``continuation`` mark go on within a word."""

    def __init__(self, tokens: dict[str, int], unknown: int,
                 continuation: str = "##", longest: int = 100):
        self.unknown, self.longest = unknown, longest
        nodes: dict[tuple[int, int], int] = {}
        ids = [-1, -1]                     # node 0 starts, node 1 goes on
        for text, i in tokens.items():
            mark = text.startswith(continuation) and text != continuation
            node = 1 if mark else 0
            for ch in text[len(continuation):] if mark else text:
                key = node, ord(ch)
                if key not in nodes:
                    nodes[key] = len(ids)
                    ids.append(-1)
                node = nodes[key]
            if node > 1:
                ids[node] = i
        keys = np.array([(a << _SHIFT) | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.child = np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.ids = np.array(ids, np.int64)

    def _longest(self, cps, at, end, root: int):
        """End and id of the longest token from ``at``; -1 if there is
        none."""
        stop, found = np.full(len(at), -1), np.full(len(at), -1)
        if not len(self.keys):
            return stop, found
        on = np.arange(len(at))
        node, place = np.full(len(at), root), at.copy()
        while len(on):
            key = (node << _SHIFT) | cps[place]
            slot = np.minimum(np.searchsorted(self.keys, key),
                              len(self.keys) - 1)
            hit = self.keys[slot] == key
            on, node, place = on[hit], self.child[slot[hit]], place[hit] + 1
            token = self.ids[node]
            ends = token >= 0
            stop[on[ends]], found[on[ends]] = place[ends], token[ends]
            more = place < end[on]
            on, node, place = on[more], node[more], place[more]
        return stop, found

    def __call__(self, cps: np.ndarray, offsets: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in sequence and the n+1 offsets of each row's."""
        cps, start, end, ptr = words(cps, offsets)
        one, back = distinct(cps, start, end)
        ids, edge = self._spell(cps.astype(np.int64), start[one], end[one])
        n = np.diff(edge)[back]
        return (ids[_flat(edge[:-1][back], n)],
                np.concatenate([[0], np.cumsum(n)])[ptr])

    def _spell(self, cps, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in sequence and the n+1 offsets of each word's."""
        at = start.copy()
        spelt = end - start <= self.longest
        on = np.flatnonzero(spelt)
        of, ids, root = [], [], 0
        while len(on):
            stop, found = self._longest(cps, at[on], end[on], root)
            spelt[on[stop < 0]] = False
            on, stop, found = (x[stop >= 0] for x in (on, stop, found))
            at[on] = stop
            of.append(on)
            ids.append(found)
            on, root = on[stop < end[on]], 1
        bad = np.flatnonzero(~spelt)
        of = np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64)
        ids = np.concatenate([*ids, np.zeros(0, np.int64)])
        keep = spelt[of] if len(of) else np.zeros(0, bool)
        of = np.concatenate([of[keep], bad])
        ids = np.concatenate([ids[keep], np.full(len(bad), self.unknown)])
        order = np.argsort(of, kind="stable")     # pieces came in sequence
        n = np.bincount(of, minlength=len(start)).astype(np.int64)
        return ids[order].astype(np.int32), np.concatenate(
            [[0], np.cumsum(n)])
