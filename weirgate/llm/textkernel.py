"""Vectorised tokenising and hashing of Arrow text columns.

Everything here works on whole Arrow batches as byte arrays: delimiters are ASCII, so word borders can be
found in UTF-8 directly, and a word's 64-bit hash is a difference of prefix sums. Two different words share
a hash with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Arrays from this size on are given back to the system when they are freed (glibc's option of that name is -3).
_MMAP_THRESHOLD, MMAP_BYTES = -3, 4 << 20


def lean(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``task`` for an Arrow stage, in a worker that keeps no freed memory while it works or waits for the next task."""

    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(_MMAP_THRESHOLD, MMAP_BYTES)
        except (OSError, AttributeError):  # another C library
            libc = None
        try:
            yield from task(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return run

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

#: Bytes of text tokenised at once (a longer document is taken whole).
CHUNK_BYTES = 1 << 19


def _byte_codes() -> np.ndarray:
    codes = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    codes[65:91] = codes[97:123]  # A-Z hash as a-z
    return codes


_CODES = _byte_codes()
#: Words are runs of bytes that aren't one of space, \t, \n, \v, \f, \r.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(CHUNK_BYTES + 1, n) if n <= CHUNK_BYTES + 1 else n
        for key, base in (("p", _P), ("i", _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of some documents: byte range and hash of each, and where each document's words begin."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def word(self, i: int) -> bytes:
        return self.text[self.start[i] : self.end[i]].tobytes().lower()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes together, at least one document each."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray, hashes: bool = True) -> Words:
    """Words (runs of bytes of ``kind``) of the documents with these offsets; hashes ignore the case of A-Z."""
    text, o = data[off[0] : off[-1]], off - off[0]
    n = len(text)
    is_word = kind[text]
    begins, ends = is_word.copy(), is_word.copy()
    if n:
        begins[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        full = o[1:] > o[:-1]
        head, tail = o[:-1][full], o[1:][full] - 1
        begins[head], ends[tail] = is_word[head], is_word[tail]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, o)
    h = np.zeros(len(start), np.uint64)
    if hashes and len(start):
        p, inv = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[text] * p[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    return Words(text, start, end, first, h)


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` tokens that stays in its document, and the token each run begins at."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    seed = 0x2545F4914F6CDD1D
    for j in range(size):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out += mix(h[j : j + n] + U64(j)) * U64(seed | 1)
    inside = np.ones(n, bool)
    for f in range(1, size):  # a window may not begin in the last size - 1 tokens of a document
        border = first[1:-1] - f
        inside[border[(border >= 0) & (border < n)]] = False
    lengths = np.diff(first)
    if (lengths < size).any():  # short documents: no window begins in them
        for d in np.flatnonzero((lengths < size) & (lengths > 0)):
            inside[first[d] : min(first[d + 1], n)] = False
    at = np.flatnonzero(inside)
    return mix(out[at]), at


def lower_ascii(text: str) -> str:
    """``text`` with A-Z in lower case and all else as it is."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
