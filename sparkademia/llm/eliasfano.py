"""Elias-Fano encoding of sorted 64-bit keys, vectorised with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_MAX_LOW = 56


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """`width` bits of each value, most significant first, one after another."""
    n = len(values)
    if not width or not n:
        return np.zeros(8, np.uint8)
    shifts = np.arange(width - 1, -1, -1, dtype=U64)
    parts = []
    for i in range(0, n, 1 << 15):  # a multiple of 8 values ends on a whole byte
        v = values[i : i + (1 << 15)]
        parts.append(np.packbits(((v[:, None] >> shifts) & U64(1)).astype(np.uint8).ravel()))
    parts.append(np.zeros(8, np.uint8))  # so that any read of 8 bytes stays inside
    return np.concatenate(parts)


def _unpack(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at the positions `at`."""
    if not width:
        return np.zeros(len(at), U64)
    bit = at.astype(np.int64) * width
    byte, off = bit >> 3, (bit & 7).astype(U64)
    word = np.zeros(len(at), U64)
    for k in range(8):
        word = (word << U64(8)) | packed[byte + k].astype(U64)
    return (word << off) >> U64(64 - width)


class EliasFano:
    """A sorted set of distinct uint64 keys in about 2 + log2(universe / n) bits each.

    The low bits of each key are packed; the high bits are kept in unary: for each value of the high part, a one per key
    and then a zero. Counts of zeros per 64-bit word make the select of a zero one binary search.
    """

    __slots__ = ("n", "base", "width", "low", "high", "zeros", "tops")

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, U64)
        out = _Writer(len(keys), keys[0] if len(keys) else U64(0), keys[-1] if len(keys) else U64(0))
        out.add(keys)
        self._take(out)

    def _take(self, w: "_Writer") -> "EliasFano":
        self.n, self.base, self.width, self.tops, self.high = w.n, w.base, w.width, w.tops, w.high
        self.low = np.concatenate([*w.low, _pack(w.rest, w.width)])
        return self._count()

    def _count(self) -> "EliasFano":
        words = self.high.view(">u8")
        ones = np.concatenate([np.bitwise_count(words[i : i + (1 << 16)]) for i in range(0, len(words), 1 << 16)])
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones.astype(np.int64))])
        return self

    @property
    def bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.zeros.nbytes

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th zero (from 0) in the unary part."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        rest = k - self.zeros[word]
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1)
        seen = np.cumsum(1 - bits, axis=1, dtype=np.int16)
        return word * 64 + np.argmax(seen > rest[:, None], axis=1)

    def successor_index(self, probes: np.ndarray) -> np.ndarray:
        """For each probe the index of the smallest key that isn't below it; n where there is none."""
        probes = np.asarray(probes, U64)
        out = np.full(len(probes), self.n, np.int64)
        if not self.n:
            return out
        out[probes <= self.base] = 0
        rel = np.where(probes > self.base, probes - self.base, U64(0))
        top = rel >> U64(self.width)  # may exceed a signed number
        inside = np.flatnonzero((probes > self.base) & (top < U64(self.tops)))
        if not len(inside):
            return out
        t = top[inside].astype(np.int64)
        want = rel[inside] & U64((1 << self.width) - 1)
        end = self._select0(t) - t
        at = np.where(t > 0, self._select0(np.maximum(t - 1, 0)) - t + 1, 0)
        live = at < end
        while live.any():
            k = np.flatnonzero(live)
            below = _unpack(self.low, self.width, at[k]) < want[k]
            at[k] += below
            live[k] = below & (at[k] < end[k])
        out[inside] = at
        return out

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """Whether each probe is a key: its successor is the probe itself."""
        probes = np.asarray(probes, U64)
        at = self.successor_index(probes)
        found = at < self.n
        if found.any():
            k = np.flatnonzero(found)
            rel = probes[k] - self.base
            low_equal = _unpack(self.low, self.width, at[k]) == (rel & U64((1 << self.width) - 1))
            top = rel >> U64(self.width)
            ok = (probes[k] >= self.base) & low_equal & (top < U64(self.tops))
            top = np.where(ok, top, U64(0)).astype(np.int64)
            ok &= at[k] < self._select0(top) - top  # the successor lies under the same high part
            found[k] = ok
        return found

    def blocks(self, size: int = 1 << 15) -> Iterator[np.ndarray]:
        """The keys in order, a block of the unary part at a time."""
        i = 0
        for at in range(0, len(self.high), size):
            ones = np.flatnonzero(np.unpackbits(self.high[at : at + size]))[: self.n - i]
            if len(ones):
                place = np.arange(i, i + len(ones))
                tops = (ones + at * 8 - place).astype(U64)
                yield self.base + ((tops << U64(self.width)) | _unpack(self.low, self.width, place))
                i += len(ones)

    def decode(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, U64), *self.blocks()])

    def merge(self, new: np.ndarray) -> "EliasFano":
        """The union with a sorted batch of keys that aren't in the set. Both are read in sequence and written on block by
        block; the old set is never decoded as a whole."""
        if not len(new):
            return self
        if not self.n:
            return EliasFano(new)
        out = _Writer(self.n + len(new), min(self.base, new[0]), max(self.last, new[-1]))
        done = 0
        for old in self.blocks():
            upto = int(np.searchsorted(new, old[-1]))
            part = new[done:upto]
            if len(part):
                both = np.concatenate([old, part])
                both.sort(kind="stable")
                out.add(both)
            else:
                out.add(old)
            done = upto
        out.add(new[done:])
        return out.close()

    @property
    def last(self) -> np.uint64:
        """The highest key."""
        return (self.base + ((U64(self.tops - 1) << U64(self.width)) | _unpack(self.low, self.width, np.array([self.n - 1]))))[0]

    def to_bytes(self) -> bytes:
        head = np.array([self.n, int(self.base), self.width, self.tops, len(self.low)], U64)
        return head.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        head = np.frombuffer(data, U64, 5)
        self = cls.__new__(cls)
        self.n, self.base, self.width, self.tops = int(head[0]), head[1], int(head[2]), int(head[3])
        body = np.frombuffer(data, np.uint8, offset=40)
        self.low, self.high = body[: int(head[4])], body[int(head[4]) :]
        return self._count()


class _Writer:
    """Writes a set of known size and ends from sorted blocks of keys; besides the set's own bytes it holds a block."""

    def __init__(self, n: int, first: np.uint64, last: np.uint64):
        self.n, self.base = n, first
        span = int(last - first) + 1 if n else 1
        self.width = min(_MAX_LOW, max(0, (span // max(n, 1)).bit_length() - 1))
        self.tops = int((last - first) >> U64(self.width)) + 1 if n else 0
        self.high = np.zeros(((n + self.tops + 63) // 64 + 1) * 8, np.uint8)
        self.low: list[np.ndarray] = []
        self.rest, self.done = np.zeros(0, U64), 0

    def add(self, keys: np.ndarray) -> None:
        for i in range(0, len(keys), 1 << 15):
            rel = keys[i : i + (1 << 15)] - self.base
            bit = (rel >> U64(self.width)).astype(np.int64) + np.arange(self.done, self.done + len(rel))
            np.bitwise_or.at(self.high, bit >> 3, np.right_shift(np.uint8(128), (bit & 7).astype(np.uint8)))
            self.done += len(rel)
            low = np.concatenate([self.rest, rel & U64((1 << self.width) - 1)])
            whole = len(low) & ~7  # a multiple of 8 values ends on a whole byte
            if whole and self.width:
                self.low.append(_pack(low[:whole], self.width)[:-8])
            self.rest = low[whole:]

    def close(self) -> EliasFano:
        return EliasFano.__new__(EliasFano)._take(self)


class SeenKeys:
    """Which keys of a stream came before: an Elias-Fano set, and new keys in sorted runs, each more than twice as long as
    the next, that are merged into it when they exceed `least` keys and an eighth of the set. So a key is moved about
    log2(n) times in all, and memory stays at the set's size plus that of the runs."""

    def __init__(self, initial: EliasFano | None = None, least: int = 1 << 16):
        self.set = initial or EliasFano(np.zeros(0, U64))
        self.runs: list[np.ndarray] = []
        self.least = least

    @property
    def bytes(self) -> int:
        return self.set.bytes + sum(r.nbytes for r in self.runs)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """For a batch in order of arrival: whether each key came before, in the batch or earlier."""
        uniq, first = np.unique(np.asarray(keys, U64), return_index=True)
        seen = np.ones(len(keys), bool)
        old = self.set.contains(uniq)
        for run in self.runs:
            at = np.searchsorted(run, uniq)
            inside = at < len(run)
            old[inside] |= run[at[inside]] == uniq[inside]
        seen[first] = old
        fresh = uniq[~old]
        if len(fresh):
            self.runs.append(fresh)
            while len(self.runs) > 1 and 2 * len(self.runs[-1]) > len(self.runs[-2]):
                self._join()
            if sum(map(len, self.runs)) > max(self.least, self.set.n // 8):
                self.flush()
        return seen

    def _join(self) -> None:
        both = np.concatenate([self.runs.pop(), self.runs.pop()])
        both.sort(kind="stable")  # two sorted runs: one pass
        self.runs.append(both)

    def flush(self) -> EliasFano:
        while len(self.runs) > 1:
            self._join()
        if self.runs:
            self.set = self.set.merge(self.runs.pop())
        return self.set
