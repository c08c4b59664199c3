"""Sets of word shingles as 64-bit hashes, for many documents at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * _U(step)
        done, step = done + take, step * step & (1 << 64) - 1
    return out


class Words:
    """Hashes of lower-cased words; keeps its tables of powers between calls."""

    def __init__(self):
        self.up, self.down = powers(_BASE, 1 << 16), powers(_INVERSE, 1 << 16)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of each word of the documents data[offsets[i]:offsets[i + 1]]."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > len(self.up):
            self.up, self.down = powers(_BASE, 2 * n), powers(_INVERSE, 2 * n)
        printed = ~_SPACE[data]
        begin = np.zeros(n, bool)  # a document's first byte
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        head = printed & (begin | np.r_[True, ~printed[:-1]])
        tail = printed & np.r_[begin[1:] | ~printed[1:], True]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * self.up[:n], out=sums[1:])
        a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
        h = mix((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64))
        return h, np.searchsorted(offsets, a, "right") - 1


def sets(hashes: np.ndarray, docs: np.ndarray, number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document, sorted, and where each document's begin (number + 1 offsets).

    A document of fewer words, but not none, has its whole sequence as its only shingle.
    """
    words = np.bincount(docs, minlength=number)
    ends = np.cumsum(words)
    starts = ends - words
    salts = mix(np.arange(1, n + 1, dtype=np.uint64) * _U(_BASE))
    parts = [np.zeros(0, np.uint64)]
    if len(hashes) >= n:
        gram = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            gram += mix(hashes[k : len(hashes) - n + 1 + k] ^ salts[k])
        gram = mix(gram)
    sizes = np.zeros(number, np.int64)
    for i in range(number):
        a, b = int(starts[i]), int(ends[i])
        if b - a >= n:
            part = np.sort(gram[a : b - n + 1])
            part = part[np.r_[True, part[1:] != part[:-1]]]
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole += mix(hashes[k : k + 1] ^ salts[k - a])
            part = mix(whole + _U(b - a))
        else:
            continue
        parts.append(part)
        sizes[i] = len(part)
    return np.concatenate(parts), np.r_[0, np.cumsum(sizes)]
