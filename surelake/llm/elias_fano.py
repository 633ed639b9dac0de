"""Elias-Fano sequences and n-gram trie levels, with vectorised look-ups, over memory-mapped buffers."""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

U = np.uint64


def mapped(arrays: Iterable[np.ndarray]) -> list[np.ndarray]:
    """The arrays, laid on end into one anonymous memory map."""
    arrays = list(arrays)
    sizes = [-(-a.nbytes // 8) * 8 for a in arrays]
    if not sum(sizes):
        return arrays
    buffer, at, out = mmap.mmap(-1, sum(sizes)), 0, []
    for a, size in zip(arrays, sizes, strict=True):
        view = np.frombuffer(buffer, a.dtype, len(a), at) if len(a) else a
        if len(a):
            view[:] = a
        out.append(view)
        at += size
    return out


class Sequence:
    """A non-decreasing sequence of unsigned numbers in about 2 + log2(universe / n) bits each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n = n
        top = int(values[-1]) if n else 0
        self.bits = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(U)
        low = values & U((1 << self.bits) - 1)
        self.low = _pack(low, self.bits)
        self.size = n + (top >> self.bits) + 1
        flags = np.zeros(-(-self.size // 64) * 64, bool)
        flags[((values >> U(self.bits)) + np.arange(n, dtype=U)).astype(np.int64)] = True
        self.high = np.packbits(flags, bitorder="little").view(U)
        self.ones = np.append(0, np.cumsum(np.bitwise_count(self.high), dtype=np.int64))
        self.tops = top >> self.bits
        self.low, self.high, self.ones = mapped([self.low, self.high, self.ones])

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit."""
        before = self.ones if ones else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(U)
        bits = self.high[word] if ones else ~self.high[word]
        out = word * 64
        for width in (32, 16, 8, 4, 2, 1):  # halves: is the bit in the lower one?
            count = np.bitwise_count(bits & U((1 << width) - 1)).astype(U)
            up = left >= count
            left -= np.where(up, count, U(0))
            bits = np.where(up, bits >> U(width), bits)
            out += np.where(up, width, 0)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        return _unpack(self.low, i, self.bits)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (((self._select(i, True) - i).astype(U)) << U(self.bits)) | self._low(i)

    def every(self) -> np.ndarray:
        """All values, decoded in one pass."""
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        i = np.arange(self.n, dtype=np.int64)
        return ((place - i).astype(U) << U(self.bits)) | self._low(i)

    def values(self, i: np.ndarray) -> np.ndarray:
        """As ``access``; many at once are decoded together."""
        return self.every()[i] if 4 * len(i) >= self.n else self.access(i)

    def _end(self, h: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Where the values of high bits h end, which begin at place lo: after the set bits that follow there."""
        at = lo + h
        word, off = np.minimum(at >> 6, len(self.high) - 1), (at & 63).astype(U)
        clear = ~(self.high[word] >> off)
        run = np.bitwise_count((clear & (~clear + U(1))) - U(1)).astype(np.int64)  # set bits from there on
        out = lo + run
        more = np.flatnonzero(run >= 64 - off.astype(np.int64))  # beyond the word
        if len(more):
            inner = h[more] < self.tops
            out[more] = self.n
            some = more[inner]
            out[some] = self._select(h[some], False) - h[some]
        return np.minimum(out, self.n)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per number, the first place whose value is not smaller (n if there is none), and whether it is the number itself."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = np.minimum(x >> U(self.bits), U(self.tops + 1)).astype(np.int64)
        h = np.minimum(high, self.tops)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0) if self.tops else np.zeros(len(h), np.int64)
        last = self._end(h, lo)
        low, end = x & U((1 << self.bits) - 1), last.copy()
        busy = np.flatnonzero(lo < end)
        while len(busy):  # binary search among those of equal high bits
            mid = (lo[busy] + end[busy]) // 2
            less = self._low(mid) < low[busy]
            lo[busy[less]] = mid[less] + 1
            end[busy[~less]] = mid[~less]
            busy = busy[lo[busy] < end[busy]]
        there = np.flatnonzero((lo < last) & (high <= self.tops))
        found = np.zeros(len(x), bool)
        found[there] = self._low(lo[there]) == low[there]
        return np.where(high > self.tops, self.n, lo), found

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Per number, the first place whose value is not smaller; n if there is none."""
        return self.search(x)[0]


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    n = len(values)
    if not bits or not n:
        return np.zeros(0, U)
    out = np.zeros(n * bits // 64 + 2, U)
    at = np.arange(n, dtype=np.int64) * bits
    word, off = at >> 6, (at & 63).astype(U)
    np.bitwise_or.at(out, word, values << off)
    over = off + U(bits) > U(64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (U(64) - off[over]))
    return out


def _unpack(packed: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), U)
    at = i * bits
    word, off = at >> 6, (at & 63).astype(U)
    value = packed[word] >> off
    over = off > 0
    value[over] |= packed[word[over] + 1] << (U(64) - off[over])
    return value & U((1 << bits) - 1)


#: What codes stand for: 0 for nothing, 1 to 4095 for powers of ten from 1 down to 10**-9, closer together near 1, where
#: logarithms are small. The same in every trie, whatever it holds.
_NEAR = 0.05
_RATE = np.log((9 + _NEAR) / _NEAR) / 4094
BOOK = np.append(-np.inf, _NEAR - _NEAR * np.exp(_RATE * np.arange(4095)))


def coded(logs: np.ndarray) -> np.ndarray:
    """The nearest code of each log10; 4095 for all below the last one."""
    return (np.clip(np.rint(np.log((_NEAR - logs) / _NEAR) / _RATE), 0, 4094) + 1).astype(np.uint16)


class Level:
    """A trie level: for each parent, its successors in ascending order, each with a code.

    The pointers to each parent's first successor are one Elias-Fano sequence. A successor is stored plus the last stored value of
    the parent before, so that all of them make another; it is found by a search relative to its parent's base.
    """

    def __init__(self, parents: int, parent: np.ndarray, successor: np.ndarray, code: np.ndarray):
        """Rows sorted by (parent, successor): the parent's place in the level above, 32 bits, a code."""
        n = len(parent)
        count = np.bincount(parent, minlength=parents)
        ends = np.cumsum(count)
        self.pointers = Sequence(np.append(0, ends))
        last = np.zeros(parents, U)
        some = count > 0
        last[some] = successor[ends[some] - 1].astype(U) + U(1)
        base = np.cumsum(last, dtype=U) - last
        self.successors = Sequence(successor.astype(U) + base[parent] if n else np.zeros(0, U))
        (self.code,) = mapped([code])

    def find(self, parent: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The place of each successor of its parent, -1 where it is not; parents of -1 have none. Equal parents come together."""
        out = np.full(len(parent), -1, np.int64)
        if not self.successors.n:
            return out
        some = np.flatnonzero(parent >= 0)
        mine = parent[some]
        new = np.append(True, mine[1:] != mine[:-1])[: len(mine)]
        asked, which = mine[new], np.cumsum(new) - 1
        lo, hi = self.pointers.values(asked).astype(np.int64), self.pointers.values(asked + 1).astype(np.int64)
        base = np.where(lo > 0, self.successors.values(np.maximum(lo - 1, 0)) + U(1), U(0))
        at, ok = self.successors.search(successor[some].astype(U) + base[which])
        ok &= at < hi[which]
        out[some[ok]] = at[ok]
        return out

    def nbytes(self) -> int:
        return self.pointers.nbytes() + self.successors.nbytes() + self.code.nbytes


class Trie:
    """Contexts u, their successors v and the successors w of (u, v), in levels with pointers from each to the next.

    Codes are quantised smoothed probabilities: of v after u, count(u, v) / (count(u) + mu[0]), and of w after (u, v),
    count(u, v, w) / (count(u, v) + mu[1]).
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray, of_u: np.ndarray, mu: tuple[float, float], end: int):
        """Distinct paths in ascending order with their counts, and the count of each one's u. A w of ``end`` is no successor: the path ends at v."""
        n = len(u)
        new_u = np.ones(n, bool)
        new_u[1:] = u[1:] != u[:-1]
        new_v = new_u.copy()
        new_v[1:] |= v[1:] != v[:-1]
        begin = np.flatnonzero(new_v)
        pair = np.cumsum(new_v) - 1
        of_pair = np.add.reduceat(count, begin) if n else np.zeros(0, np.int64)
        self.contexts = Sequence(u[new_u])
        self.second = Level(int(new_u.sum()), (np.cumsum(new_u) - 1)[begin], v[begin], coded(np.log10(of_pair / (of_u[begin] + mu[0]))))
        on = w != end
        self.third = Level(len(begin), pair[on], w[on], coded(np.log10(count[on] / (of_pair[pair[on]] + mu[1]))))

    def find(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """[paths, 2]: the codes of v after u and of w after (u, v); 0 for what is not there. Paths ascend."""
        out = np.zeros((len(u), 2), np.uint16)
        if not self.contexts.n or not len(u):
            return out
        new_u = np.ones(len(u), bool)
        new_u[1:] = u[1:] != u[:-1]
        new_v = new_u.copy()
        new_v[1:] |= v[1:] != v[:-1]
        place, there = self.contexts.search(u[new_u])
        context = np.where(there, place.astype(np.int64), -1)[np.cumsum(new_u) - 1]
        pair = self.second.find(context[new_v], v[new_v])[np.cumsum(new_v) - 1]
        out[pair >= 0, 0] = self.second.code[pair[pair >= 0]]
        path = self.third.find(pair, w)
        out[path >= 0, 1] = self.third.code[path[path >= 0]]
        return out

    def nbytes(self) -> int:
        return self.contexts.nbytes() + self.second.nbytes() + self.third.nbytes()
