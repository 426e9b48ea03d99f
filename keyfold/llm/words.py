"""Words of Arrow text batches as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, after A-Z are lower-cased; all
separators are ASCII, so UTF-8 text is cut byte by byte. Texts are taken whole; batches are cut into
pieces of a few MB by row, so memory follows the longest text and not the batch. Null is like empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes of text handled at once (one row at least)
ROWS = 1 << 15  # rows handled at once
LONG = 32  # bytes of a word that word_hash takes eight at a time

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least, modulo 2**64."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            size = len(_powers[k])
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, size, 1 << 64))])
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes; spans in order, without overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    terms = _BYTE[data]
    terms *= up[: len(data)]
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    if cuts[-1] == len(data):
        cuts = cuts[:-1]
    sums = np.add.reduceat(terms, cuts)[0::2]
    return mix(sums * down[starts])


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes, other than span_hash's: eight bytes at a time, so short spans (words) cost a step or two each and not one for each byte."""
    size = ends - starts
    padded = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    eights = padded.view("<u8")

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes, those from ``left`` on as 0."""
        own, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((eights[own] >> shift) | (eights[own + 1] << (np.uint64(64) - shift))) & _FIRST[np.minimum(left, 8)]  # a shift by 64 gives 0

    out = mix(eight(starts, size) + size.astype(np.uint64) * np.uint64(_BASE))
    more = np.flatnonzero(size > 8)
    for k in range(8, LONG, 8):
        out[more] = mix(out[more] + np.uint64(_BASE) * eight(starts[more] + k, size[more] - k))
        more = more[size[more] > k + 8]
    if len(more):  # longer than LONG: by their bytes
        edge = np.append(0, np.cumsum(size[more]))
        bytes_of = data[np.arange(edge[-1]) + np.repeat(starts[more] - edge[:-1], size[more])]
        out[more] = span_hash(bytes_of, edge[:-1], edge[1:])
    return out


class Spans:
    """Hashes of any spans of some bytes: running sums once, then one difference a span. Equal bytes have equal hashes, here and in span_hash."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


class Words(NamedTuple):
    """Words of some texts: ``off`` has where each text's words begin, with one more entry at the end."""

    data: np.ndarray  # lower-cased bytes of the texts
    text_off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def folded(self) -> Words:
        """With the accented capitals of Latin-1 (C3 80 to C3 9E, but 97) in lower case too."""
        up = np.flatnonzero((self.data[:-1] == 0xC3) & (self.data[1:] >= 0x80) & (self.data[1:] <= 0x9E) & (self.data[1:] != 0x97)) + 1
        self.data[up] += 0x20
        return self

    def rows(self) -> np.ndarray:
        """The number of its text for each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of a few MB of texts each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    data, off = text_buffers(column)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), lo + ROWS, len(column))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    pa.default_memory_pool().release_unused()  # a worker holds one batch, not what earlier ones needed


def find_words(raw: np.ndarray, off: np.ndarray, classes: np.ndarray = _IS_WORD) -> Words:
    """Runs of bytes of one class other than 0; by default class 1 is all but white space."""
    data = raw + (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))  # A-Z in lower case; in arithmetic, which is faster than a table
    inside = (raw != 0x20) & ((raw - np.uint8(9)) > 4) if classes is _IS_WORD else classes[raw]
    if inside.dtype != bool:
        return _runs(data, inside, off)
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    heads = off[:-1][off[:-1] < n]
    before[heads] = False
    after[heads[heads > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, off, starts, ends, np.searchsorted(starts, off))


def _runs(data: np.ndarray, kind: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    change = np.ones(n + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[off] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    use = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[use], ends[use]
    return Words(data, off, starts, ends, np.searchsorted(starts, off))


#: Letters, digits and all bytes from 0x80: 1; other bytes that are no white space: 2.
WORD_PUNCT = np.where(_IS_WORD, 2, 0).astype(np.int8)
WORD_PUNCT[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1

#: Letters, digits and all bytes from 0x80; all else parts words.
ALNUM = WORD_PUNCT == 1


def words_of(column: pa.Array | pa.ChunkedArray, classes: np.ndarray = _IS_WORD) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, raw, off in pieces(column):
        yield lo, hi, find_words(raw, off, classes)


def shingles(h: np.ndarray, off: np.ndarray, k: int, bits: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as (hashes, offsets); ascending within a text.

    A text with fewer than k words, but one at least, has its whole sequence as its only shingle. Hashes have
    ``bits`` bits, so that the text's number fits beside them and one plain sort does for all texts.
    """
    n = np.diff(off)
    rows = len(n)
    if rows > 1 << (64 - bits):
        raise ValueError("too many texts at once")
    mult = seeded(k, 977)
    whole = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(rows), whole)
    at = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(off[:-1], whole)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value += h[at + j] * mult[j]
    keys = [(row.astype(np.uint64) << np.uint64(bits)) | (mix(value) >> np.uint64(64 - bits))]
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        value = np.full(len(few), size, np.uint64)
        for j in range(size):
            value += h[off[few] + j] * mult[j] * np.uint64(2 * size + 1)
        keys.append((few.astype(np.uint64) << np.uint64(bits)) | (mix(value) >> np.uint64(64 - bits)))
    keys = np.sort(np.concatenate(keys))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    bounds = np.searchsorted(keys, np.arange(rows, dtype=np.uint64) << np.uint64(bits)) if rows else np.zeros(0, np.int64)
    return keys & np.uint64((1 << bits) - 1), np.append(bounds, len(keys))
