"""Vectorised text primitives shared by the Arrow-side operators of this subpackage.

A batch of texts becomes one flat array of code points; words, word hashes and word-shingle hashes
are then array expressions, so no Python loop runs per character, word or shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Multiplier of the polynomial word hash; odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
#: Texts are worked on in slices of about this many code points, which bounds a worker's memory.
SLICE_CHARS = 1_000_000
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def alnum_table() -> np.ndarray:
    """True at each code point that is a letter or a digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@cache
def alpha_table() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions 0 to n - 1."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_CHARS + 4096)
        _powers[:] = []
        for step in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, np.uint64(step), dtype=np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
    return _powers[0][:n], _powers[1][:n]


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``limit`` code points; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def pieces(text: str, limit: int = SLICE_CHARS, keep: int = SHINGLE - 1) -> Iterator[str]:
    """Cuts a very long text between words; each piece repeats the last ``keep`` words of the one before.

    So each shingle of ``keep + 1`` words lies in exactly one piece.
    """
    start = 0
    while len(text) - start > limit:
        end = start + limit
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[start:end]
        back, seen = end, 0
        while back > start and seen < keep:
            while back > start and not text[back - 1].isalnum():
                back -= 1
            while back > start and text[back - 1].isalnum():
                back -= 1
            seen += 1
        start = back if seen == keep and back > start else end
    yield text[start:]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The row and the 64-bit hash of each word (run of letters and digits, case folded by lower())."""
    flat = codes("\n".join(texts).lower() + "\n")
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), dtype=np.int64, count=len(texts))
    inside = alnum_table()[flat]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate((np.zeros(1, dtype=edge.dtype), edge))
    first, last = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(flat))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power)))
    hashes = mix((total[last] - total[first]) * inverse[first])
    return np.searchsorted(np.cumsum(lengths), first, side="right"), hashes


def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The row and the 64-bit hash of each run of ``k`` words, repeats included, in order of place."""
    rows, hashes = words(texts)
    if len(hashes) < k:
        return rows[:0], hashes[:0]
    n, total, factor = len(hashes) - k + 1, np.zeros(len(hashes) - k + 1, dtype=np.uint64), 1
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * _STEP & _MASK
    same = rows[:n] == rows[k - 1 :]
    return rows[:n][same], mix(total[same])


def all_shingles(texts: list[str], k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``shingles`` slice by slice; rows count from the start of ``texts``."""
    for a, b in slices(texts):
        if b - a == 1 and len(texts[a]) > SLICE_CHARS:
            for piece in pieces(texts[a], keep=k - 1):
                rows, hashes = shingles([piece], k)
                yield rows + a, hashes
        else:
            rows, hashes = shingles(texts[a:b], k)
            yield rows + a, hashes
