"""NumPy kernels over Arrow string batches: word spans, word hashes, shingle hashes.

Everything works on the UTF-8 bytes of a batch at once; no per-word Python objects are made.
Documents are taken in chunks of about ``CHUNK_BYTES`` (a longer document is a chunk of its own),
so memory is bounded by the chunk or the longest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

# Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed, or compared, one at a time.
LONG = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a lane


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair64(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix64(x * _STEP + y)


def lanes(data: np.ndarray, padded: bool = False) -> np.ndarray:
    """The eight bytes from each byte on, as a number; ``padded``: ``data`` has eight bytes to spare."""
    if not padded:
        data = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes.  Eight bytes at a time are mixed in, long spans are digested."""
    size = end - start
    at = lanes(data)
    out = mix64((size.astype(np.uint64) * _SEED) ^ (at[start] & _FIRST[np.minimum(size, 8)]))
    own, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(own):
        out[own] = mix64(out[own] ^ (at[start[own] + k] & _FIRST[np.minimum(size[own] - k, 8)]))
        k += 8
        own = own[size[own] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def same_spans(one: np.ndarray, start: np.ndarray, other: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = LONG) -> np.ndarray:
    """Whether ``one[s:s + n]`` and ``other[b:b + n]`` are equal, for every span.  Both have eight bytes to spare;
    spans of more than ``most`` bytes are compared one at a time."""
    out = np.ones(len(size), bool)
    x, y = lanes(one, True), lanes(other, True)
    own, k = np.flatnonzero(size <= most), 0
    while len(own := own[size[own] > k]):
        out[own] &= ((x[start[own] + k] ^ y[begin[own] + k]) & _FIRST[np.minimum(size[own] - k, 8)]) == 0
        k += 8
    for i in np.flatnonzero(size > most).tolist():
        out[i] = np.array_equal(one[start[i] : start[i] + size[i]], other[begin[i] : begin[i] + size[i]])
    return out


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive values, from pairs of pairs."""
    if len(values) < n:
        return values[:0]
    power, width, out, have = values, 1, None, 0
    while True:
        if n & width:
            out = power if out is None else pair64(out[: len(values) - have - width + 1], power[have:])
            have += width
        if 2 * width > n:
            return mix64(out + np.uint64(n))
        power = pair64(power[:-width], power[width:])
        width *= 2


def whole(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each short run ``values[s:s + n]``, n from 1 on."""
    out = values[starts]
    for k in range(1, int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        out[own] = pair64(out[own], values[starts[own] + k])
    return mix64(out + sizes.astype(np.uint64))


@dataclass
class Words:
    """Words of a chunk of documents.

    ``first[i]:first[i + 1]`` are the words of document ``row0 + i``; ``start`` and ``end`` are
    byte offsets into ``data``.
    """

    row0: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document (counted from 0 in this chunk) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for runs of rows that hold about ``limit`` bytes."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


#: For words of letters and digits alone; bytes of other scripts count as letters.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def words(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES, table: np.ndarray = _IS_WORD) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row (or runs of the bytes in ``table``); ``lower``
    folds A-Z first."""
    for row, data, offsets in chunks(column, limit):
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = data + upper.astype(np.uint8) * np.uint8(32)
        inside = table[data]
        edge = np.zeros(len(data) + 1, dtype=bool)  # a document ends before this byte
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Words(row, data, start, end, np.searchsorted(start, offsets))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within one document, and the index of each run's first word."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    at = np.arange(count.sum()) + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return runs(hashes, n)[at] if len(at) else hashes[:0], at


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(s, s + n)`` for each pair."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def shingles(column: pa.Array, n: int = 5) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-cased words, sorted distinct shingle hashes of all rows, the first words of these shingles,
    offsets per row) by chunk.

    A row with fewer than ``n`` words has its whole word sequence as one shingle, a row without
    words has none.
    """
    for w in words(column, lower=True):
        h = w.hashes()
        grams, at = ngrams(h, w.first, n)
        docs = np.searchsorted(w.first, at, side="right") - 1
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            grams, docs, at = np.concatenate((grams, whole(h, w.first[short], count[short]))), np.concatenate((docs, short)), np.concatenate((at, w.first[short]))
        order = np.lexsort((grams, docs))
        grams, docs = grams[order], docs[order]
        keep = np.ones(len(grams), dtype=bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
        grams, docs = grams[keep], docs[keep]
        yield w, grams, at[order[keep]], np.searchsorted(docs, np.arange(len(w.first)))


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of all rows, offsets per row) by chunk, as in ``shingles``."""
    for w, grams, _, offsets in shingles(column, n):
        yield w.row0, grams, offsets
