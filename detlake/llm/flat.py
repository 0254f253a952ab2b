"""Flat, vectorised views of the words of many texts.

Arrow batches reach Python as lists of UTF-8 byte strings.  Everything here
works on whole chunks of them with numpy: one array of words for all texts,
never a Python loop over words.  Words are runs of bytes outside
``\\x20\\x09-\\x0D``, as ``bytes.split()`` finds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text hashed at once; bounds the 8-byte arrays over single bytes.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64 and of its inverse, n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (len(values) - k + 1 of them)."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(values) - k + 1] + np.uint64(k))


def sliding_min(values: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(values) < w:
        return values[:0]
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = least(out[:-step], out[step:])
        have += step
    return out


@dataclass
class Words:
    """Words of several texts, flat. Positions are bytes of ``buf``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word; one more at the end

    @property
    def text(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> np.ndarray:
        """For each word whether k words of its own text start there."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.start)) + k <= last


def _hashed(texts: list[bytes]) -> Words:
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    blank = _SPACE[buf]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    cut = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(buf, start, end, h, np.searchsorted(start, cut))


def words_of(texts: list[bytes]) -> Words:
    """Words of all texts; hashing runs over at most CHUNK bytes at once, or one text."""
    parts: list[Words] = []
    for some in chunks(texts, CHUNK):
        parts.append(_hashed(some))
    if len(parts) == 1:
        return parts[0]
    at, n, first = 0, 0, [np.zeros(1, np.int64)]
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in parts:
        starts.append(p.start + at)
        ends.append(p.end + at)
        first.append(p.first[1:] + n)
        at, n = at + len(p.buf), n + len(p.start)
    buf = np.concatenate([np.zeros(0, np.uint8), *(p.buf for p in parts)])
    h = np.concatenate([np.zeros(0, np.uint64), *(p.hash for p in parts)])
    return Words(buf, np.concatenate(starts), np.concatenate(ends), h, np.concatenate(first))


def chunks(items: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Consecutive items of at most ``size`` bytes together, or a single larger one."""
    some, n = [], 0
    for x in items:
        if some and n + len(x) > size:
            yield some
            some, n = [], 0
        some.append(x)
        n += len(x) + 1
    if some:
        yield some


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of buf laid end to end, with their offsets."""
    size = (end - start).astype(np.int64)
    offset = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offset[1:])
    out = np.empty(offset[-1], buf.dtype)
    at = 0
    while at < len(size):  # index arrays of at most CHUNK bytes' worth, or one slice
        to = max(at + 1, int(np.searchsorted(offset, offset[at] + CHUNK, "right")) - 1)
        low, high = offset[at], offset[to]
        out[low:high] = buf[np.arange(low, high) + np.repeat(start[at:to] - offset[at:to], size[at:to])]
        at = to
    return out, offset


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys in arrays that are sorted alike."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
