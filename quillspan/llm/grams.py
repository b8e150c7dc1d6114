"""Word and phrase ids inside tasks: 64-bit hashes, as numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S32, _S29 = np.uint64(32), np.uint64(29)
MOST_WORDS = 300_000  # that a worker remembers


class WordIds(dict):
    """Remembers the hash of each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _A
    x = (x ^ (x >> _S29)) * _B
    return x ^ (x >> _S32)


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id of each pair of neighbours; the order within the pair counts."""
    return scramble(left * _GOLDEN + right)


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash for every ``size`` ids in a row."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(size):
            h = h * _GOLDEN + ids[j : j + n]
    return scramble(h)


class BitFilter:
    """A set of ids as 2 ** ``bits`` bits and two probes: its size is fixed, it may say yes in error, never no."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray) -> None:
        self.bits = bits
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words] = values
        self.table = table.view(np.uint8)

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value], np.uint64))[0])

    @staticmethod
    def of_parts(bits: int, parts: dict[int, bytes], size: int) -> BitFilter:
        """From its bytes in parts of one size; absent ones are empty."""
        made = BitFilter(bits, np.array([], np.int64), np.array([], np.uint64))
        for i, part in parts.items():
            made.table[i * size : (i + 1) * size] = np.frombuffer(part, np.uint8)
        return made

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << bits) - 1)
        return ids & mask, (ids >> _S32) & mask

    def _probe(self, at: np.ndarray) -> np.ndarray:
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

    def has(self, ids: np.ndarray) -> np.ndarray:
        low, high = self.places(ids, self.bits)
        return (self._probe(low) & self._probe(high)).astype(bool)
