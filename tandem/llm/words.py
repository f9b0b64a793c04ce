"""Words of many texts at once, as numpy arrays. Runs inside tasks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit permutation (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def character_table(kind: str) -> np.ndarray:
    """For every code point, whether it belongs to a word (``letters`` or anything but ``spaces``)."""
    test = str.isalpha if kind == "letters" else (lambda c: not c.isspace())
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    codes: np.ndarray  # lower-cased code points of all texts, one separator after each
    inside: np.ndarray  # whether that character belongs to a word
    starts: np.ndarray  # of each word, in codes
    lengths: np.ndarray
    first: np.ndarray  # of each text, its first word; one entry more than texts

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, U64)
        chars = self.codes[self.inside].astype(U64)
        at = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(chars)) - np.repeat(at, self.lengths)
        powers = np.cumprod(np.full(int(self.lengths.max()), _STEP | U64(1)))
        return mix(np.add.reduceat((chars + U64(1)) * powers[place], at) + self.lengths.astype(U64) * _STEP)


def segment(texts: list[str | None], kind: str) -> Words:
    """Words are maximal runs of letters, or of anything but white space; null is empty."""
    low = [(t or "").lower() for t in texts]
    table = character_table(kind)
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le"), "<u4")
    inside = table[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    return Words(codes, inside, starts, ends - starts, np.searchsorted(starts, begins))


def in_chunks(texts: list, limit: int = 400_000, most: int = 100_000):
    """Ranges of at most ``most`` texts, of about ``limit`` characters together; a longer text stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and (size + n > limit or i - begin >= most):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def in_ranges(sizes: list[int], limit: int, most: int = 100_000):
    """Ranges of at most ``most`` rows, of about ``limit`` together; a larger row stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > limit or i - begin >= most):
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def text_chunks(column: pa.Array, limit: int = 400_000, most: int = 256):
    """The texts of an Arrow column a few at a time, so a worker never holds a whole batch as Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for begin, end in in_ranges(sizes, limit, most):
        yield column.slice(begin, end - begin).to_pylist()
    pa.default_memory_pool().release_unused()
