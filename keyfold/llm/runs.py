"""Runs of ascending integers as bytes, small enough to shuffle by range in place of a row for each."""

from __future__ import annotations

import numpy as np


def order_of(x: np.ndarray) -> np.ndarray:
    """The stable order of unsigned integers: a plain sort of the numbers with their places in the low bits, which is several times faster than argsort.

    Where a number and a place don't fit into 64 bits, the leading bits of the numbers do, unless numbers differ only below them; then argsort decides.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    bits, least = np.uint64(len(x).bit_length()), x.min()
    low = (np.uint64(1) << bits) - np.uint64(1)
    exact = int(x.max() - least).bit_length() + int(bits) <= 64
    at = ((x - least) << bits if exact else x & ~low) | np.arange(len(x), dtype=np.uint64)
    at.sort()
    at = (at & low).astype(np.int64)
    if not exact:
        sorted_x = x[at]
        if (sorted_x[1:] < sorted_x[:-1]).any():
            return np.argsort(x, kind="stable")
    return at


def pack_ascending(x: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending values and their counts: gaps as byte planes (their high bytes are mostly 0, which shuffles compress), then counts above 1."""
    gaps = np.diff(x, prepend=np.uint64(0))
    wide = 8 if len(gaps) and gaps[1:].max(initial=0) >= 1 << 32 else 4
    first = gaps[:1].astype(np.uint64)
    planes = gaps[1:].astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T
    many = np.flatnonzero(n > 1)
    return b"".join([np.array([len(x), wide, len(many)], np.uint32).tobytes(), first.tobytes(), np.ascontiguousarray(planes).tobytes(), many.astype(np.uint32).tobytes(), n[many].astype(np.uint32).tobytes()])


def unpack_ascending(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, wide, many = map(int, np.frombuffer(raw, np.uint32, 3))
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gaps = np.empty(size, np.uint64)
    gaps[:1] = np.frombuffer(raw, np.uint64, 1, 12)
    planes = np.frombuffer(raw, np.uint8, (size - 1) * wide, 20).reshape(wide, -1)
    gaps[1:] = np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel()
    at = 20 + (size - 1) * wide
    n = np.ones(size, np.int64)
    n[np.frombuffer(raw, np.uint32, many, at)] = np.frombuffer(raw, np.uint32, many, at + 4 * many)
    return np.cumsum(gaps), n


def planes(x: np.ndarray) -> bytes:
    """Longs as byte planes: bytes that hardly change (those of ids of one task) compress to little."""
    return np.ascontiguousarray(np.asarray(x, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()
