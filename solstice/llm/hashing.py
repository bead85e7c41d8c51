"""Hashes of words and byte windows, whole columns at a time."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: The bytes that separate words, and A-Z.
SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A random 64-bit number for each byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LOWER_VALUES = BYTE_VALUES[LOWER]


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least `size` of each."""
    size = 1 << max(16, (size - 1).bit_length())
    return _powers(int(BASE), size), _powers(int(INVERSE), size)


def sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running sums of byte value times power: any stretch's polynomial hash is a difference times an inverse power."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def windows(total: np.ndarray, size: int) -> np.ndarray:
    """The hash of each stretch of `size` bytes, from sums()."""
    n = max(0, len(total) - size)
    return mix((total[size:] - total[:n]) * powers(len(total))[1][:n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with about `most` bytes; a longer row is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def word_pieces(text: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about `most` bytes that end between words."""
    start = 0
    while start < len(text):
        end = start + most
        while end < len(text) and not (gap := SPACES[text[end : end + most]]).any():
            end += most  # a very long word
        end = min(len(text), end + int(gap.argmax())) if end < len(text) else len(text)
        yield text[start:end]
        start = end


def word_hashes(part: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of joined texts (text r is part[ends[r]:ends[r + 1]]), and how many words lie before each end."""
    total = sums(part, LOWER_VALUES)
    solid = ~SPACES[part]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = ends[:-1] < ends[1:]
    first[ends[:-1][filled]] = solid[ends[:-1][filled]]  # a text ends the word before it
    last[ends[1:][filled] - 1] = solid[ends[1:][filled] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix((total[stops] - total[starts]) * powers(len(total))[1][starts]), np.searchsorted(starts, ends)


def shingle_sets(column: pa.Array, words: int = 5, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 62-bit hashes of its word shingles.

    Words are what is between the bytes SPACES, with A-Z lower-cased. A text of fewer words
    gives the hash of its whole sequence, one without words an empty array.
    """
    data, offsets = text_bytes(column)
    for a, b in row_slices(offsets, most):
        low = offsets[a]
        part, ends = data[low : offsets[b]], offsets[a : b + 1] - low
        if b - a == 1 and len(part) > 2 * most:
            found = [word_hashes(x, np.array([0, len(x)]))[0] for x in word_pieces(part, most)]
            word, bound = np.concatenate(found), np.array([0, sum(map(len, found))])
        else:
            word, bound = word_hashes(part, ends)
        grams = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            grams = grams * BASE + word[k : k + len(grams)]
        grams = mix(grams) >> np.uint64(2)
        for i in range(b - a):
            s, e = int(bound[i]), int(bound[i + 1])
            if e - s >= words:
                yield np.unique(grams[s : e - words + 1])
            elif e > s:
                whole = np.uint64(e - s)
                with np.errstate(over="ignore"):
                    for x in word[s:e]:
                        whole = whole * INVERSE + x
                yield mix(np.array([whole])) >> np.uint64(2)
            else:
                yield np.zeros(0, np.uint64)
