"""Words, shingles and their 64-bit hashes for whole Arrow columns, in numpy.

A text column is cut into blocks of a few hundred kilobytes, never inside a text. In a block every
byte is looked at once: separators give the words, and a running sum of byte codes times powers
of a fixed odd number gives the hash of any byte range as a difference of two sums. Nothing
loops over texts or words. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

#: Separators ``[\x20\x09-\x0D]``.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Separators: every ASCII character but digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]
#: A-Z as a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), BLOCK_BYTES + 1)
        _powers = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
    return _powers, _inverses


def range_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums for range_hash; one entry more than there are codes."""
    powers, _ = _tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of codes; equal ranges have equal hashes wherever they lie."""
    _, inverses = _tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Block:
    """Neighbouring texts of a column: their bytes, and where each text starts (one entry more)."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of at most ``most`` bytes, or of one longer text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        last = min(last, n)
        low = bounds[first]
        yield Block(first, everything[low : bounds[last]], bounds[first : last + 1] - low)
        first = last


@dataclass
class Words:
    """Words of a block: byte ranges, hash, the text each belongs to, and each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def ranges(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs without a separator that stay inside one text."""
    n = len(data)
    word = (~separators).take(data)
    inner = bounds[(bounds > 0) & (bounds < n)]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    opens[inner] |= word[inner]
    closes[inner - 1] |= word[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(block: Block, separators: np.ndarray = BLANKS, fold: np.ndarray = SAME) -> Words:
    """All words of a block; ``fold`` maps bytes before hashing."""
    starts, ends = ranges(block.data, block.bounds, separators)
    sums = range_sums(_CODES[fold].take(block.data))
    first = np.searchsorted(starts, block.bounds)
    text = np.repeat(np.arange(len(block)), np.diff(first))
    return Words(starts, ends, range_hash(sums, starts, ends), text, first)


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside one text, and the index of its first word."""
    total = len(found.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(total - n + 1)
    at = at[found.text[at] == found.text[at + n - 1]]
    return range_hash(range_sums(found.hashes), at, at + n), at


def whole(found: Words, which: np.ndarray) -> np.ndarray:
    """Hash of the whole word sequence of the given texts."""
    return range_hash(range_sums(found.hashes), found.first[which], found.first[which + 1])


def per_text(found_text: np.ndarray, values: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text: sorted by text, then value; and where each text starts."""
    order = np.lexsort((values, found_text))
    t, v = found_text[order], values[order]
    if len(v):
        keep = np.ones(len(v), bool)
        keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
        t, v = t[keep], v[keep]
    return v, np.searchsorted(t, np.arange(texts + 1))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Arrow list column from flat values and list starts."""
    return pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))
