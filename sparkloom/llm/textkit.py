"""Vectorised words, hashes and shingles over Arrow string columns.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes other than
space and 0x09-0x0D, after lower-casing A-Z; these are ASCII, so cutting bytes
cuts characters nowhere. Equal words always have equal hashes; those of up to eight
bytes have hashes of their own, longer ones share one by chance only (2**-64 a pair).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of a lane, by how many of them are a word's: what is kept, and the spaces that fill the rest (no word holds one).
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_FILL = U(0x2020202020202020) & ~_KEEP
#: Words of more lanes than this are hashed one by one.
_LANES = 32
_START = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release() -> None:
    """Gives memory that no array uses back to the system: workers live on, idle ones beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def releasing(run: Callable) -> Callable:
    """A function of batches that releases memory at its end."""

    @wraps(run)
    def then(batches):
        yield from run(batches)
        release()

    return then


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    if ends is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each (a longer row is alone)."""
    at, rows = 0, len(ends) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, min(to, rows)
        at = to


def _hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words at s to e, of bytes after lower-casing A-Z.

    A word is taken in lanes of eight bytes, each mixed by a bijection into what was before,
    so words of up to eight bytes have different hashes, and longer ones meet by chance alone
    (unlike a polynomial's, whose collisions can be written down). Very long words have
    BLAKE2 digests.
    """
    low = np.full(len(data) + 16, 32, np.uint8)
    np.take(LOWER, data, out=low[: len(data)], mode="clip")
    eight = np.ndarray((len(data) + 9,), "<u8", low, strides=(1,))
    size = e - s
    left = np.minimum(size, 8)
    h = mix(_START ^ ((eight[s] & _KEEP[left]) | _FILL[left]))
    at = np.flatnonzero(size > 8)
    for lane in range(1, _LANES):
        if not len(at):
            break
        left = np.minimum(size[at] - 8 * lane, 8)
        h[at] = mix((h[at] + _START) ^ ((eight[s[at] + 8 * lane] & _KEEP[left]) | _FILL[left]))
        at = at[size[at] > 8 * (lane + 1)]
    for i in at:
        h[i] = int.from_bytes(hashlib.blake2b(low[s[i] : e[i]], digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each row's range of them (rows + 1); 0x20 must be among the spaces.

    Texts are gone through in pieces; a word that goes on in the next piece is joined.
    """
    starts, stops, sums = [], [], []
    first = np.zeros(len(data) + 1, bool)
    first[ends[:-1]] = True
    letter = ~space
    open_at = -1  # the start of a word that has not ended

    def close(s, e):
        lo, hi = int(s[0]), int(e[-1])
        starts.append(s), stops.append(e), sums.append(_hashes(data[lo:hi], s - lo, e - lo))

    for at in range(0, len(data), _PIECE):
        piece = data[at : at + _PIECE]
        n = len(piece)
        inside = letter[piece]
        edge = first[at : at + n + 1]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1:n]
        if open_at >= 0:
            if inside[0] and not edge[0]:
                begin[0] = False
            else:
                close(np.array([open_at]), np.array([at]))
                open_at = -1
        stop[-1] = False
        s, e = np.flatnonzero(begin) + at, np.flatnonzero(stop) + at + 1
        if open_at >= 0 and len(e):
            s, open_at = np.concatenate([[open_at], s]), -1
        if len(s) > len(e):
            open_at, s = int(s[-1]), s[:-1]
        if len(s):
            close(s, e)
    if open_at >= 0:
        close(np.array([open_at]), np.array([len(data)]))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U), np.zeros(len(ends), np.int64)
    s, e, h = np.concatenate(starts), np.concatenate(stops), np.concatenate(sums)
    return s, e, h, np.searchsorted(s, ends)


_COEFFICIENTS = mix(np.arange(1, 65, dtype=U)) | U(1)


def shingles(h: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `width` words (all its words as one, if fewer), and each row's range of them."""
    count = np.diff(rows)
    short = (count < width) & (count > 0)
    number = np.where(short, 1, np.maximum(count - width + 1, 0))
    out_rows = np.concatenate([[0], np.cumsum(number)])
    full = np.zeros(max(len(h) - width + 1, 0), U)
    for j in range(width):
        full += h[j : j + len(full)] * _COEFFICIENTS[j]
    full = mix(full)
    place = np.arange(out_rows[-1]) - np.repeat(out_rows[:-1], number) + np.repeat(rows[:-1], number)
    out = np.zeros(out_rows[-1], U)
    long = np.repeat(~short, number)
    out[long] = full[place[long]]
    for i in np.flatnonzero(short):
        own = h[rows[i] : rows[i + 1]]
        out[out_rows[i]] = mix((own * _COEFFICIENTS[: len(own)]).sum(dtype=U, keepdims=True) + U(len(own)))[0]
    return out, out_rows


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort is faster here than numpy's hash-based unique)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def tally(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs (or the sum of its weights)."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if weight is None:
        x = np.sort(x)
    else:
        order = np.argsort(x, kind="stable")
        x, weight = x[order], weight[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at], np.diff(np.concatenate([at, [len(x)]])) if weight is None else np.add.reduceat(weight, at)


def planes(x: np.ndarray) -> bytes:
    """Values with bytes of equal weight together: those that are all zero compress to nothing in a shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def values(data: bytes, kind: str) -> np.ndarray:
    """The values of planes()."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Lookup:
    """A read-only hash table from 64-bit keys to positions, vectorised over queries."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys.astype(U), U(0))
        left, at = np.arange(len(keys), dtype=np.int32), self._at(self.keys[:-1])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _at(self, x: np.ndarray) -> np.ndarray:
        return ((x * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is not there."""
        x = x.astype(U, copy=False)
        at = self._at(x)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != x))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.slots) - 1)
            got = self.slots[at]
            out[todo] = got
            on = (got >= 0) & (self.keys[got] != x[todo])
            todo, at = todo[on], at[on]
        return out
