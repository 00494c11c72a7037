"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks; each block starts from an empty model and carries a
checksum, so any block decodes alone. A block is cut into lanes of equal
length that are coded side by side: each array holds one value per lane, and
one step codes the next id of all lanes. The lanes share one model, which
learns from all ids of a step before the next. For every id

* an order-2 and an order-1 table predict the id that last followed the same
  two ids, and the same id;
* one symbol says which prediction is right, or that none is. Its
  frequencies mix three adaptive tables: by the confidence of both
  predictions and whether they agree, and by that of each alone;
* an id that none predicted is coded by the adaptive order-0 frequencies of
  such ids, by its halves of 16 bits if the block has ids that need more.

Order-0 frequencies are summed anew at doubling distances, those of the mix
after each of the first steps and then at short distances.

The coder is a range coder with a 62-bit range and 32-bit output words.
Totals are powers of two. A carry is added to the words before it at the end.
Words of all lanes lie in one stream in the order in which they are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 4096               # at most
LANE_IDS = 1024            # at least, but in a block of one lane
BLOCK_IDS = LANES * LANE_IDS

MAGIC = b"TLR2"
_HEAD = struct.Struct("<4sBIIII")    # magic, halves, ids, lanes, crc32, words
_PAIRS = 18                # bits of an index into the order-2 table
_SINGLES = 16              # of one into the order-1 table
_MIX, _ORDER0 = 10, 20     # bits of the totals
_STEP = 32                 # weight of an order-0 occurrence
_FIRST, _LONGEST = 1 << 11, 1 << 18  # ids between two order-0 sums
_OFTEN, _EVERY = 16, 8     # steps between two sums of the mix
_PACK = 21                 # bits of a size beside its start
_AGED = 1 << 17            # choices of a context that are halved
_LOW, _TOP = 30, 62        # bits of the least and of the largest range
_WORD = 32
_TURNED = 16               # steps whose ids are laid out by step at once


def _packed(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places in a total, as one number."""
    return (start << _PACK) | size


class _Order0:
    """Adaptive frequencies of 16-bit symbols."""

    def __init__(self, decodes: bool):
        self.count = np.zeros(1 << 16, np.int64)
        self.new: list[np.ndarray] = []
        self.held, self.distance = 0, _FIRST
        self.decodes = decodes
        self.refresh()

    def learn(self, symbols: np.ndarray) -> None:
        self.new.append(symbols)
        self.held += len(symbols)
        if self.held >= self.distance:
            self.distance = min(2 * self.distance, _LONGEST)
            self.refresh()

    def refresh(self) -> None:
        if self.new:
            self.count += np.bincount(np.concatenate(self.new),
                                      minlength=1 << 16)
        self.new, self.held = [], 0
        weight = self.count * _STEP + 1
        # every symbol has a part, the rest by weight
        size = 1 + weight * ((1 << _ORDER0) - (1 << 16)) // int(
            weight.sum())
        self.part = _packed(np.cumsum(size) - size, size)
        if self.decodes:
            self.symbol = np.repeat(np.arange(1 << 16, dtype=np.uint16),
                                    size)


class _Model:
    """What the lanes of a block share. An entry of a prediction table is an
    id above three bits of confidence."""

    def __init__(self, lanes: int, halves: int, decodes: bool):
        self.halves = halves
        self.one = np.zeros(lanes, np.uint32)
        self.two = np.zeros(lanes, np.uint32)
        # the order-2 table, then the order-1 table
        self.table = np.zeros((1 << _PAIRS) + (1 << _SINGLES),
                              np.uint32 if halves == 1 else np.uint64)
        self.order0 = [_Order0(decodes) for _ in range(halves)]
        # how often order 2, order 1, none was right: by whether both agree
        # and the confidence of both
        self.right = np.zeros((2, 8, 8, 4), np.int64)
        self.chosen: list[np.ndarray] = []
        self.step = 0
        self.refresh()

    def refresh(self) -> None:
        """Sizes and starts of the mix from all choices so far."""
        for code in self.chosen:
            self.right += np.bincount(code, minlength=512).reshape(2, 8, 8, 4)
        self.chosen = []
        both = self.right[..., :3]
        both -= (both.sum(3, keepdims=True) > _AGED) * (both >> 1)
        mixed = both << 10
        for axis in (1, 2):
            own = both.sum(axis, keepdims=True)
            mixed = mixed + ((own + 1) << 12) // (
                own.sum(3, keepdims=True) + 3)
        size = 1 + mixed * ((1 << _MIX) - 3) // mixed.sum(3, keepdims=True)
        stop = np.cumsum(size, axis=3)
        self.mix = np.zeros((2, 8, 8, 4), np.int64)
        self.mix[..., :3] = _packed(stop - size, size)
        self.mix = self.mix.reshape(-1)
        self.edges = _packed(stop[..., 0], stop[..., 1]).reshape(-1)

    def predict(self, k: int) -> None:
        """Predictions of the first ``k`` lanes and their places in the mix."""
        one = self.one[:k]
        self.slots = np.empty((2, k), np.int64)
        pair = self.two[:k] * 0x85EBCA6B
        pair += one * 0x9E3779B1
        pair >>= 32 - _PAIRS
        self.slots[0] = pair
        if self.halves > 1:
            one = (one * 0x9E3779B1) >> (32 - _SINGLES)
        np.add(one, 1 << _PAIRS, out=self.slots[1])
        entry = self.table.take(self.slots, mode="clip")
        self.guess = entry >> 3
        self.trust = entry.astype(np.uint8) & 7
        self.at = self.trust[0] << 3
        self.at |= self.trust[1]
        self.at |= (self.guess[0] == self.guess[1]).view(np.uint8) << 6

    def choices(self, symbol: np.ndarray) -> np.ndarray:
        """Places in the mix of one symbol for each lane."""
        code = self.at.astype(np.int64)
        code <<= 2
        code += symbol
        self.chosen.append(code)
        return self.mix.take(code, mode="clip")

    def learn(self, k: int, ids: np.ndarray, hits: np.ndarray) -> None:
        """``hits``: which ids were predicted, by order."""
        trust = self.trust + (self.trust < 7).view(np.uint8)
        trust *= hits.view(np.uint8)
        entry = trust.astype(self.table.dtype)
        entry |= ids << 3
        self.table[self.slots] = entry
        self.two[:k] = self.one[:k]
        self.one[:k] = ids
        self.step += 1
        if self.step <= _OFTEN or self.step % _EVERY == 0:
            self.refresh()

    def parts(self, ids: np.ndarray):
        """The halves of ids that weren't predicted, highest first."""
        for half in range(self.halves - 1, -1, -1):
            yield self.order0[half], ((ids >> (16 * half)) & 0xFFFF
                                      ).astype(np.int64)


class _Encoder:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << _TOP) - 1, np.int64)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def widen(self, low, rng, lanes=None) -> None:
        """Put a word of ranges that are too small. ``lanes``: theirs, if
        not the first."""
        due = (rng < 1 << _LOW).nonzero()[0]
        if len(due):
            old = low[due]
            self.lanes.append((due if lanes is None else lanes[due])
                              .astype(np.uint16))
            self.words.append(old >> _LOW)
            low[due] = (old & ((1 << _LOW) - 1)) << _WORD
            rng[due] <<= _WORD

    @staticmethod
    def put(low, rng, bits: int, part) -> None:
        """Narrow ranges to a part of their total."""
        rng >>= bits
        low += (part >> _PACK) * rng
        part &= (1 << _PACK) - 1
        rng *= part

    def finish(self) -> np.ndarray:
        n = len(self.low)
        every = np.arange(n, dtype=np.uint16)
        last = [self.low >> _LOW, (self.low & ((1 << _LOW) - 1)) << 2]
        lanes = np.concatenate([*self.lanes, every, every])
        by_lane = np.argsort(lanes, kind="stable")
        words = np.concatenate([*self.words, *last])[by_lane]
        first = np.zeros(n, np.int64)
        np.cumsum(np.bincount(lanes)[:-1], out=first[1:])
        # a lane's first word has no carry
        while (carry := words >> _WORD).any():
            words &= (1 << _WORD) - 1
            words[:-1] += carry[1:]
        # two zero bits before each lane, so that 62 bits end with a word
        before = (words & 3) << (_WORD - 2)
        words >>= 2
        before[first[1:] - 1] = 0
        words[1:] |= before[:-1]
        # A lane's first two words are read at once, then one for each that
        # it put: the order of putting, after two more for each lane.
        at = np.empty(len(words), np.int64)
        at[2:] = by_lane[:-2] + 2 * n
        at[first], at[first + 1] = every, every + n
        out = np.empty(len(words), "<u4")
        out[at] = words
        return out


class _Decoder:
    def __init__(self, words: np.ndarray, lanes: int):
        self.words = words
        self.at = 2 * lanes
        first, second = words[:lanes], words[lanes:2 * lanes]
        self.code = (first.astype(np.int64) << _WORD) | second
        self.range = np.full(lanes, (1 << _TOP) - 1, np.int64)

    def widen(self, code, rng) -> None:
        due = (rng < 1 << _LOW).nonzero()[0]
        if len(due):
            word = self.words[self.at:self.at + len(due)]
            if len(word) < len(due):
                raise ValueError("a block of token ids is damaged")
            self.at += len(due)
            code[due] = (code[due] << _WORD) | word
            rng[due] <<= _WORD

    @staticmethod
    def look(code, rng, bits: int) -> np.ndarray:
        """Place of the code in the total."""
        rng >>= bits
        return code // rng

    @staticmethod
    def take(code, rng, part) -> None:
        code -= (part >> _PACK) * rng
        part &= (1 << _PACK) - 1
        rng *= part


def _layout(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids, and their length; the last may be
    shorter."""
    lanes = min(LANES, max(1, -(-n // LANE_IDS)))
    steps = -(-n // lanes)
    return -(-n // steps) if n else 0, steps


def _encode(ids: np.ndarray, halves: int) -> tuple[int, np.ndarray]:
    lanes, steps = _layout(len(ids))
    grid = np.zeros(lanes * steps, np.uint32 if halves == 1 else np.uint64)
    grid[:len(ids)] = ids
    grid = grid.reshape(lanes, steps)
    model, out = _Model(lanes, halves, False), _Encoder(lanes)
    short = len(ids) - (lanes - 1) * steps       # length of the last lane
    for t in range(steps):
        k = lanes if t < short else lanes - 1
        if t % _TURNED == 0:
            rows = np.ascontiguousarray(np.ascontiguousarray(
                grid[:, t:t + _TURNED]).T)
        x = rows[t % _TURNED, :k]
        model.predict(k)
        hits = model.guess == x
        miss = ~hits
        none = miss[0] & miss[1]
        low, rng = out.low[:k], out.range[:k]
        out.widen(low, rng)
        out.put(low, rng, _MIX, model.choices(
            miss[0].view(np.uint8) + none.view(np.uint8)))
        own = none.nonzero()[0]
        if len(own):
            low2, rng2 = low.take(own), rng.take(own)
            for half, (order0, y) in enumerate(model.parts(x.take(own))):
                if half:
                    out.widen(low2, rng2, own)
                out.put(low2, rng2, _ORDER0, order0.part.take(
                    y, mode="clip"))
                order0.learn(y)
            low[own], rng[own] = low2, rng2
        model.learn(k, x, hits)
    return lanes, out.finish()


def _decode(words: np.ndarray, n: int, lanes: int, halves: int) -> np.ndarray:
    steps = -(-n // lanes)
    grid = np.zeros((lanes, steps), np.uint32)
    rows = np.zeros((_TURNED, lanes), np.uint32)
    model, inp = _Model(lanes, halves, True), _Decoder(words, lanes)
    short = n - (lanes - 1) * steps
    for t in range(steps):
        k = lanes if t < short else lanes - 1
        model.predict(k)
        code, rng = inp.code[:k], inp.range[:k]
        inp.widen(code, rng)
        value = inp.look(code, rng, _MIX)
        edges = model.edges.take(model.at, mode="clip")
        miss = value >= edges >> _PACK
        none = value >= edges & ((1 << _PACK) - 1)
        inp.take(code, rng, model.choices(
            miss.view(np.uint8) + none.view(np.uint8)))
        x = np.where(miss, model.guess[1], model.guess[0])
        own = none.nonzero()[0]
        if len(own):
            code2, rng2 = code.take(own), rng.take(own)
            y = np.zeros(len(own), x.dtype)
            for half in range(halves - 1, -1, -1):
                order0 = model.order0[half]
                if half < halves - 1:
                    inp.widen(code2, rng2)
                part = order0.symbol.take(inp.look(code2, rng2, _ORDER0),
                                          mode="clip").astype(np.int64)
                inp.take(code2, rng2, order0.part.take(part, mode="clip"))
                order0.learn(part)
                y <<= 16
                y |= part.astype(x.dtype)
            code[own], rng[own] = code2, rng2
            x[own] = y
        rows[t % _TURNED, :k] = x
        if t % _TURNED == _TURNED - 1 or t == steps - 1:
            first = t // _TURNED * _TURNED
            grid[:, first:t + 1] = np.ascontiguousarray(
                rows[:t + 1 - first].T)
        model.learn(k, x, model.guess == x)
    return grid.reshape(-1)[:n]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of 32-bit ids as bytes, of any number and length."""
    out = []
    for own in blocks:
        halves = 1 if int(own.max(initial=0)) < 1 << 16 else 2
        lanes, words = _encode(own, halves) if len(own) else (
            0, np.zeros(0, "<u4"))
        out.append(_HEAD.pack(MAGIC, halves, len(own), lanes, zlib.crc32(
            own.astype("<u4")), len(words)) + words.tobytes())
    return out


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """Ids of each block; a block that fails its checksum is an error."""
    out = []
    for d in data:
        if len(d) < _HEAD.size:
            raise ValueError("not a block of token ids, or cut short")
        magic, halves, n, lanes, crc, size = _HEAD.unpack_from(d)
        if magic != MAGIC or len(d) != _HEAD.size + 4 * size or halves \
                not in (1, 2) or lanes != _layout(n)[0]:
            raise ValueError("not a block of token ids, or cut short")
        words = np.frombuffer(d, "<u4", offset=_HEAD.size)
        ids = _decode(words, n, lanes, halves) if n else np.zeros(0, "<u4")
        if zlib.crc32(ids) != crc:
            raise ValueError("a block of token ids is damaged")
        out.append(ids.astype("<u4", copy=False))
    return out
