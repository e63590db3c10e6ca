"""Words of many texts at once, as arrays: where they start and end, and 64-bit hashes of them and of their sequences."""

from __future__ import annotations

import hashlib

import numpy as np

from decisia.llm.memory import thrifty

thrifty()

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK_BYTES = 500_000

#: Letters of a word up to which its hash is a sum of random numbers, one for each place and letter; longer words have a digest.
TABLED = 64

_random = np.random.Generator(np.random.PCG64(20240607))
TABLE = _random.integers(0, 1 << 64, TABLED * 256, dtype=np.uint64)
STEPS, OTHER_STEPS = (_random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
SECOND = np.uint64(0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit; the array is changed in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """buf: the texts, each with a space after it; start, end: of each word; first[i]: number of words before text i."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        space = SPACES[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.buf) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.space = space
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.at)

    def hashes(self) -> np.ndarray:
        """Of each word 64 bits: two different words are alike with a probability of 2^-64, whatever their letters, since what each letter adds at each place is drawn on its own.

        Words are taken a block at a time, since eight bytes a letter are at work.
        """
        out = np.empty(len(self.start), np.uint64)
        if not len(out):
            return out
        first = 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(self.start, self.start[first] + BLOCK_BYTES)))
            start, end = self.start[first:last], self.end[first:last]
            lo = int(start[0])
            hi = min(int(end[-1]), int(start[-1]) + TABLED)
            at = np.arange(lo, hi, dtype=np.int32 if hi < 1 << 31 else np.int64)
            at -= np.repeat(start.astype(at.dtype), np.diff(np.append(start, hi)))
            at = np.minimum(at, TABLED - 1)
            at *= 256
            at += self.buf[lo:hi]
            value = TABLE[at]
            value[self.space[lo:hi]] = 0
            out[first:last] = np.add.reduceat(value, start - lo)
            for k in np.flatnonzero(end - start > TABLED).tolist():
                word = self.buf[start[k] : end[k]].tobytes()
                out[first + k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            mixed(out[first:last])
            first = last
        return out


def runs(hashes: np.ndarray, n: int, steps: np.ndarray = STEPS) -> np.ndarray:
    """A hash for each n consecutive of them."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count] * steps[0]
    for j in range(1, n):
        out += hashes[j : j + count] * steps[j]
    return mixed(out)


def other_runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A second hash for each n consecutive, of other steps over other words' hashes: with runs() 128 bits of a sequence."""
    return runs(mixed(hashes ^ SECOND), n, OTHER_STEPS)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    width, out = 1, values
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def within_texts(first: np.ndarray, n: int) -> np.ndarray:
    """Which n consecutive words, by the number of the first of them, lie in one text."""
    total = int(first[-1])
    if total < n:
        return np.empty(0, np.int64)
    ok = np.ones(total - n + 1, bool)
    for edge in np.unique(first[1:-1]).tolist():
        ok[max(0, edge - n + 1) : edge] = False
    return np.flatnonzero(ok)
