"""Words of a text as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """word bytes -> XXH64; forgets all once it holds `most` words, so memory is bounded."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of all windows of `width` symbols, from prefix sums."""

    def __init__(self, base: int, width: int):
        self.base, self.inverse, self.width = base | 1, pow(base | 1, -1, 1 << 64), width
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out, k, p = np.ones(n, np.uint64), 1, b
            while k < n:  # out[k:2k] = out[:k] * b**k
                out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(p)
                p, k = p * p & (1 << 64) - 1, 2 * k
            return out

        self.up, self.down = powers(self.base), powers(self.inverse)

    def windows(self, h: np.ndarray) -> np.ndarray:
        """A hash for each start of a full window; none if h is shorter than a window."""
        n = len(h)
        if n < self.width:
            return np.empty(0, np.uint64)
        if n > len(self.up):
            self._grow(max(n, 2 * len(self.up)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.up[:n], out=sums[1:])
        return (sums[self.width :] - sums[: n - self.width + 1]) * self.down[: n - self.width + 1]
