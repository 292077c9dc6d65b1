"""Vectorised text primitives over Arrow string buffers.

Everything here works on one contiguous byte buffer plus offsets, so that a
whole Arrow batch is handled by a few numpy passes and no Python code runs
per row or per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the numpy temporaries of a worker.
SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def squeeze(*parts: bytes) -> bytes:
    """Parts joined and compressed, for the shuffle and the memory of those who wait for it."""
    whole = b"".join(parts)
    return np.int64(len(whole)).tobytes() + pa.compress(whole, codec="zstd", asbytes=True)


def unsqueeze(b: bytes) -> bytes:
    size = int(np.frombuffer(b, np.int64, 1)[0])
    return pa.decompress(b[8:], size, codec="zstd", asbytes=True) if size else b""


def planes48(x: np.ndarray) -> bytes:
    """Byte planes of 48-bit values; of sorted ones the high planes compress to almost nothing."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unplanes48(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(b, np.uint8).reshape(6, -1).T
    return raw.view(np.uint64).ravel()


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task should hold none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps what it likes
        pass


def tidy(function: Callable) -> Callable:
    """A function of Arrow tables or batches, one or two arguments, that gives its memory back when it is done."""

    def call(*args):
        try:
            out = function(*args)
            return _drained(out) if isinstance(out, Iterator) else out
        finally:
            give_back()

    # Spark counts the arguments, and knows by annotations which function takes batches one by one
    if function.__code__.co_argcount == 2:
        run = lambda a, b: call(a, b)
    else:
        run = lambda a: call(a)
    if function.__annotations__.get("batches"):
        run.__annotations__ = {"a": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _drained(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser; spreads every input bit over the 64 output bits."""
    x = np.atleast_1d(x)  # scalars would warn of the intended overflow
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def signed(x) -> int:
    """A mixed value as the signed 64-bit integer that Spark holds."""
    return int(mix64(np.uint64(x)).view(np.int64)[0])


def in_order(name: np.ndarray) -> np.ndarray:
    """Places of 64-bit hashes by their leading bits, equal ones as they come: places take the bits that tell least,
    so that plain values are sorted."""
    low = np.uint64((1 << len(name).bit_length()) - 1)
    return (np.sort((name & ~low) | np.arange(len(name), dtype=np.uint64)) & low).astype(np.int64)


def places(known: np.ndarray, asked: np.ndarray, bits: int) -> np.ndarray:
    """``np.searchsorted`` of hashes of so many bits: their leading bits tell where to begin, as they are spread evenly."""
    drop = np.uint64(max(0, bits - len(known).bit_length()))
    heads = np.searchsorted(known, np.arange(1 << (bits - int(drop)), dtype=np.uint64) << drop)
    at = heads[asked >> drop]
    padded = np.append(known, np.uint64(0xFFFFFFFFFFFFFFFF))
    left = np.flatnonzero(padded[at] < asked)
    while len(left):
        at[left] += 1
        left = left[padded[at[left]] < asked[left]]
    return at


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch, each of about ``most`` bytes of text and one row at least."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(off, off[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of bytes that are no separators, ASCII white space unless told."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~separator[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _MUL)]), dtype=np.uint64)
        _INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INV)]), dtype=np.uint64)
    return _POWERS, _INVERSES


class SpanHash:
    """64-bit polynomial hashes of arbitrary spans of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        powers, self._inv = _powers(len(buf) + 1)
        self._sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sum[ends] - self._sum[starts]) * self._inv[starts]
        return mix64(h ^ (ends - starts).astype(np.uint64))


def lowered(arr: pa.Array) -> pa.Array:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.utf8_lower(arr)


def word_ngrams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word n-gram; a text of 1 to n-1 words has one gram of all of them."""
    starts, ends, rows = word_spans(buf, off)
    if not len(starts):
        return rows, np.zeros(0, np.uint64)
    words = SpanHash(buf)(starts, ends)
    count = np.bincount(rows, minlength=len(off) - 1)
    left = np.cumsum(count)[rows] - np.arange(len(rows))  # words from here to the end of the row
    full = np.flatnonzero(left >= n)
    h = np.zeros(len(full), np.uint64)
    for k in range(n):
        h = mix64(h * _MUL + words[full + k])
    short_rows = np.flatnonzero((count > 0) & (count < n))
    if len(short_rows):
        begin = np.cumsum(count) - count
        more = np.zeros(len(short_rows), np.uint64)
        for k in range(n - 1):
            has = count[short_rows] > k
            at = begin[short_rows] + np.minimum(k, count[short_rows] - 1)
            more = np.where(has, mix64(more * _MUL + words[at]), more)
        return np.concatenate([rows[full], short_rows]), np.concatenate([h, more])
    return rows[full], h


def distinct(rows: np.ndarray, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, hashes cut to ``bits`` bits; ordered by row, then hash."""
    shift = np.uint64(bits)
    key = np.sort((rows.astype(np.uint64) << shift) | (h >> np.uint64(64 - bits)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> shift).astype(np.int64), key & ((np.uint64(1) << shift) - np.uint64(1))
