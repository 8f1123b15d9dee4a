"""Sets of word shingles and their signatures, computed in numpy for one text at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Rows hashed at once, so that a long text needs no more memory than a short one.
CHUNK = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word; A-Z lower-cased, words cut at the ASCII blanks only."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), U, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of the whole sequence when there are fewer."""
    width = min(width, len(words))
    n = len(words) - width + 1 if width else 0
    out = np.zeros(n, U)
    for j in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingles of a text, empty for one without words."""
    return np.unique(window_hashes(word_hashes(text), width))


class Signature:
    """Minima of ``size`` hash functions over a set, 16 bits each, big-endian so that bytes sort like numbers."""

    def __init__(self, size: int, seed: int = 11):
        seeds = mix(np.arange(1, 2 * size + 1, dtype=U) + U(seed * 1_000_003))
        self.a, self.b = seeds[:size] | U(1), seeds[size:]

    def of(self, items: np.ndarray) -> np.ndarray:
        low = None
        for start in range(0, len(items), CHUNK):
            part = ((items[start : start + CHUNK, None] * self.a + self.b) >> U(24)).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return (mix(low) >> U(48)).astype(">u2")


def same_share(x: bytes, y: bytes) -> int:
    """Positions in which two signatures agree."""
    return int((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).sum())


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0, len(y)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both, len(x) + len(y) - both
