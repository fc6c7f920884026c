"""Words of many texts at once: boundaries and hashes by numpy over the bytes of an Arrow column.

A word is a run of bytes other than space and the control characters 9 to 13. Words are compared by 64-bit hashes: eight bytes
after the other go through a mixing that is not linear, so no pattern of bytes makes words collide. Runs of words are compared
by polynomials modulo the prime 2^61 - 1; where 128 bits are asked for, by two of them over two hashes of each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # arrays of 8 bytes per byte of text stay in cache and far below the memory of a worker
PRIME = (1 << 61) - 1
BASES = (0x1E3779B97F4A7C1B, 0x11B54A32D192ED03)  # below the prime
KEYS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))  # of the two hashes of a word

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256).astype(np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product modulo the prime, by halves of 31 and 30 bits."""
    low, mask = np.uint64(31), np.uint64((1 << 31) - 1)
    a0, a1, b0, b1 = a & mask, a >> low, b & mask, b >> low
    middle = a1 * b0 + a0 * b1
    return folded(folded(a0 * b0) + np.uint64(2) * (a1 * b1) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << low))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo the prime, for i below n at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        pair = []
        for base in (BASES[which], pow(BASES[which], -1, PRIME)):
            row = np.ones(1, dtype=np.uint64)
            while len(row) < size:
                row = np.concatenate([row, times(row, np.uint64(pow(base, len(row), PRIME)))])
            pair.append(row)
        have = _POWERS[which] = (pair[0], pair[1])
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and each row's offset; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


@dataclass
class Words:
    """starts, ends: byte positions in data; first: number of the first word of each row, and the number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False, key: int = 0) -> np.ndarray:
        """64 bits for each word; the two keys give hashes that have nothing to do with each other."""
        data = _LOWER[self.data] if lower else self.data
        eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        sizes = self.ends - self.starts
        out = mixed(sizes.astype(np.uint64) ^ KEYS[key])
        left, at = np.arange(len(sizes)), self.starts
        while len(left):  # eight bytes more of every word that has them
            rest = self.ends[left] - at
            out[left] = mixed((out[left] ^ (eights[at] & _FIRST_BYTES[np.minimum(rest, 8)])) * np.uint64(0x9FB21C651E98DF25) + KEYS[key])
            left, at = left[rest > 8], at[rest > 8] + 8
        return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here[:-1] & (~before[:-1] | cut[:-1]))
    ends = np.flatnonzero(before[1:] & (~here[1:] | cut[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


MIX = np.uint64(0x9E3779B97F4A7C15)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, put together by halves: a run of 2k words from two of k."""
    out, have, half, size = None, 0, hashes, 1
    while n:
        if n & 1:
            m = max(len(hashes) - have - size + 1, 0)
            out = half if out is None else mixed(out[:m] * MIX + half[have : have + m])
            have += size
        n >>= 1
        if n:
            m = max(len(half) - size, 0)
            half = mixed(half[:m] * MIX + half[size : size + m] + np.uint64(size))
            size *= 2
    return mixed(out ^ np.uint64(have))


def short_runs(hashes: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A hash of the words from `at` up to `to`, word by word: for runs of a few words and of different lengths."""
    out = mixed((to - at).astype(np.uint64))
    for k in range(int((to - at).max(initial=0))):
        here = np.flatnonzero(at + k < to) if k else slice(None)
        out[here] = mixed(out[here] * MIX + hashes[at[here] + k])
    return out


@dataclass
class Rolling:
    """Polynomial sums over sequences of word hashes; `run(i, n)` identifies the words from i up to n."""

    sums: tuple[np.ndarray, ...]

    @classmethod
    def over(cls, *hashes: np.ndarray) -> Rolling:
        """One polynomial for each sequence of hashes."""
        sums = []
        for k, row in enumerate(hashes):
            terms = times(folded(row), powers(k, len(row) + 1)[0][: len(row)])
            total = np.zeros(len(row) + 1, dtype=np.uint64)
            # The high and the low bits are added up apart: neither sum overflows.
            high, low = np.cumsum(terms >> np.uint64(31), dtype=np.uint64), np.cumsum(terms & np.uint64((1 << 31) - 1), dtype=np.uint64)
            total[1:] = folded(times(folded(high), np.uint64(1 << 31)) + folded(low))
            sums.append(total)
        return cls(tuple(sums))

    def run(self, at: np.ndarray, to: np.ndarray, part: int = 0) -> np.ndarray:
        total = self.sums[part]
        here = total[to] + np.uint64(PRIME) - total[at]
        return mixed(times(folded(here), powers(part, len(total))[1][at]) + ((to - at).astype(np.uint64) << np.uint64(61)) + (to - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i that has so many."""
    have, size = x, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, and where in it each distinct tuple begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if len(order) == 0:
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)
