"""Vectorised word segmentation and rolling hashes over the byte buffer of an Arrow string column.

A word is a run of bytes other than the space and 0x09-0x0D. Hashes are polynomials modulo the prime 2**31 - 1 at two
points, 62 bits in all; sums of ``value * base**i`` make the hash of any stretch available from two prefix sums. Whoever
takes equal hashes for equal stretches compares the stretches themselves (``Memo``, ``exact_ids``) or a strong digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from agora.llm.runtime import offsets_of

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PRIME, SHIFT = np.uint64((1 << 31) - 1), np.uint64(31)
#: Values that are worked on at once.
BLOCK = 1 << 20
_points: dict[int, list[int]] = {}
_powers: dict[int, np.ndarray] = {}


def points(turn: int) -> list[int]:
    """The two points of a numbered hash; every turn has others."""
    if turn not in _points:
        _points[turn] = np.random.default_rng([20_24, turn]).integers(1 << 16, int(PRIME) - 1, 2).tolist()
    return _points[turn]


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> SHIFT)
    x = (x & PRIME) + (x >> SHIFT)
    x = (x & PRIME) + (x >> SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint32)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, reduced(have * np.uint64(pow(base, len(have), int(PRIME)))).astype(np.uint32)])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of stretches of a value sequence, below 2**62."""

    def __init__(self, values: np.ndarray, turn: int = 0):
        n = len(values)
        self.bases = points(turn)
        self.sums = [np.zeros(n + 1, np.uint64) for _ in self.bases]
        for lo in range(0, n, BLOCK):
            part = reduced(values[lo : lo + BLOCK].astype(np.uint64) + np.uint64(1))
            for base, sums in zip(self.bases, self.sums, strict=True):
                run = sums[lo + 1 : lo + 1 + len(part)]
                np.cumsum(reduced(part * powers(base, n)[lo : lo + len(part)]), out=run)
                run += sums[lo]
        self.back = [powers(pow(base, -1, int(PRIME)), n + 1) for base in self.bases]

    def residues(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Of values[starts:ends], elementwise, for both points; independent of where the stretch lies."""
        return [reduced(reduced(sums[ends] - sums[starts]) * back[starts]) for sums, back in zip(self.sums, self.back, strict=True)]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = self.residues(starts, ends)
        return (a << SHIFT) | b


def runs(size: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring stretches with at most ``limit`` values in all, or of one."""
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places in the stretches that begin at ``starts``, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int = 0) -> np.ndarray:
    """Hashes of stretches that follow each other in ``data``."""
    out = np.zeros(len(starts), np.uint64)
    for lo, hi in runs(ends - starts):
        base = int(starts[lo])
        out[lo:hi] = Rolling(data[base : int(ends[hi - 1])], turn).of(starts[lo:hi] - base, ends[lo:hi] - base)
    return mix(out + ((ends - starts).astype(np.uint64) << np.uint64(40)))


def all_equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> bool:
    """Whether a[at : at + size] is b[to : to + size] throughout."""
    return all(np.array_equal(a[spread(at[lo:hi], size[lo:hi])], b[spread(to[lo:hi], size[lo:hi])]) for lo, hi in runs(size))


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each stretch: equal ones, and only those, have the same. Hashes are tried until none misleads."""
    turn, size = 0, ends - starts
    while True:
        _, first, ids = np.unique(stretch_hashes(data, starts, ends, turn), return_index=True, return_inverse=True)
        leads = first[ids]
        if np.array_equal(size, size[leads]) and all_equal(data, starts, data, starts[leads], size):
            return ids
        turn += 1


def window_ids(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The same for the windows ids[start : start + width]."""
    turn = 0
    while True:
        _, first, found = np.unique(Rolling(ids, turn).of(starts, starts + width), return_index=True, return_inverse=True)
        leads = starts[first[found]]
        if all(np.array_equal(ids[starts + k], ids[leads + k]) for k in range(width)):
            return found
        turn += 1


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts, one after the other
    bounds: np.ndarray  #: byte offset of each text, and the end
    starts: np.ndarray  #: byte offset of each word
    ends: np.ndarray
    first: np.ndarray  #: index of the first word of each text, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, turn: int = 0) -> np.ndarray:
        return stretch_hashes(self.data, self.starts, self.ends, turn)


def words(texts: pa.Array, between: np.ndarray = SPACE) -> Words:
    """The runs of bytes that are not ``between``, of each text."""
    ends = offsets_of(texts)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    solid = ~between[data]
    if not len(solid):
        return Words(data, bounds, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(solid))]
    before[inner], after[inner - 1] = False, False
    starts, stops = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return Words(data, bounds, starts, stops, np.searchsorted(starts, bounds))


class HashSlots:
    """A set of nonzero 64-bit keys by open addressing; callers keep values by slot."""

    def __init__(self, size: int):
        self.size, self.filled = size, 0
        self.keys = np.zeros(size, np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each key's slot, or that of the first free one after it."""
        at = (h & np.uint64(self.size - 1)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.size - 1)
            k = self.keys[at[open_]]
            open_ = open_[(k != h[open_]) & (k != 0)]
        return at

    def claim(self, h: np.ndarray) -> np.ndarray:
        """Enters distinct new keys; their slots."""
        out, left = np.zeros(len(h), np.int64), np.arange(len(h))
        while len(left):
            slot = self.find(h[left])
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]] = h[left[first]]
            out[left[first]] = slot[first]
            left = np.delete(left, first)
        self.filled += len(h)
        return out


class Memo:
    """Numbers for stretches of arrays, remembered from call to call.

    A stretch is looked up by its hash and compared with what is stored under it, element by element. Should two that
    differ have one hash, or should the slots be half full, the memo starts anew, with another hash in the first case.
    """

    def __init__(self, slots: int, kind: type, fill: Callable[["Memo"], None]):
        """``fill`` is called whenever the memo starts anew, to enter what is always known."""
        self.room, self.kind, self.fill, self.turn = slots, kind, fill, 0
        self.clear()

    def clear(self) -> None:
        self.slots = HashSlots(self.room)
        self.entry = np.zeros(self.room, np.int32)
        self.at, self.size = np.zeros(self.room // 2, np.int64), np.zeros(self.room // 2, np.int64)
        self.pool, self.used, self.count = np.zeros(1 << 16, self.kind), 0, 0
        self.fill(self)
        self.known = self.count

    def enter(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        new = slice(self.count, self.count + len(h))
        self.at[new], self.size[new] = self.used + np.cumsum(size) - size, size
        before, self.used = self.used, self.used + int(size.sum())
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:before], np.zeros(2 * self.used - before, self.kind)])
        self.pool[before : self.used] = data[spread(starts, size)]
        self.entry[self.slots.claim(h)] = np.arange(new.start, new.stop)
        self.count += len(h)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
        """The number of each stretch. ``learn`` gets the places of new ones, which are numbered on in that order."""
        while True:
            h = stretch_hashes(data, starts, ends, self.turn)
            h[h == 0] = 1
            slot = self.slots.find(h)
            new = np.flatnonzero(self.slots.keys[slot] == 0)
            if len(new):
                fresh, where = np.unique(h[new], return_index=True)
                if 2 * (self.count + len(fresh)) > self.room:
                    self.room *= 1 if self.count > self.known else 2
                    self.clear()
                    continue
                where = new[where]
                self.enter(fresh, data, starts[where], ends[where])
                learn(starts[where], ends[where])
                slot = self.slots.find(h)
            entry, size = self.entry[slot], ends - starts
            if np.array_equal(self.size[entry], size) and all_equal(data, starts, self.pool, self.at[entry], size):
                return entry
            self.turn += 1
            self.clear()


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 joined by the pairs (a, b): each node's least reachable node."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nearer = label[label]
            if np.array_equal(nearer, label):
                break
            label = nearer
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label
