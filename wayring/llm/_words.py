"""Vectorised word boundaries and 64-bit hashes over the bytes of an Arrow batch.

A batch of texts is one byte buffer plus document offsets.  Words are found with boolean masks and hashed
eight bytes at a time, so no Python loop runs per word; only words beyond ``LONG_WORD`` bytes are hashed one by one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of an Arrow batch are worked on in slices of about this many text bytes.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: White space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is no letter or digit; bytes from 0x80 on belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 that spreads the weak low bits of the prefix-sum hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW, _INV = out
    return _POW, _INV


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``most`` text bytes, with their bytes and offsets; nulls count as empty."""
    column = pc.fill_null(batch.column(text), "").cast(pa.large_string())
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if len(column) and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start), data[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start]
        start = stop


def spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each document's first word (one longer than the documents)."""
    word = ~sep[buf]
    first = word.copy()
    last = word.copy()
    if len(buf) > 1:
        before = word[:-1].copy()
        inner = offs[(offs > 0) & (offs < len(buf))]
        before[inner - 1] = False  # a document's end also ends its last word
        first[1:] &= ~before
        after = word[1:].copy()
        after[inner - 1] = False
        last[:-1] &= ~after
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


#: Words of more bytes than this are hashed by blake2b.
LONG_WORD = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_CHAIN = np.uint64(0x9FB21C651E98DF25)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the end is filled up with zeros."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[starts:ends]; equal strings have equal hashes anywhere.

    Every eight bytes pass through :func:`mix`, which is no linear function of them, so words of a regular
    structure collide no more often than others.
    """
    starts, sizes = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = eights(buf)
    out = mix((data[starts] & _KEEP[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _CHAIN)
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    at = 8
    while len(left):
        rest = sizes[left] - at
        out[left] = mix(out[left] * _CHAIN ^ (data[starts[left] + at] & _KEEP[np.minimum(rest, 8)]))
        at += 8
        left = left[rest > 8]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`span_hash`: for strings of up to 256 bytes, or where equal hashes of long structured words do no harm."""
    pows, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pows[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[starts:ends]; equal strings have equal hashes anywhere."""
    _, inv = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


_KEPT: list[tuple[tuple, Any]] = []


def kept(make: Callable[..., Any], *args: Any) -> Any:
    """``make(*args)``, kept for the next task of this worker; what another operator kept before is dropped."""
    key = (make, *args)
    for known, value in _KEPT:
        if known == key:
            return value
    if any(known[0].__module__ != make.__module__ for known, _ in _KEPT):
        _KEPT.clear()
    value = make(*args)
    _KEPT.append((key, value))
    return value


def forget() -> None:
    """Drop what this worker has kept, for tasks that need the memory."""
    global _POW, _INV
    _KEPT.clear()
    _POW, _INV = np.ones(1, np.uint64), np.ones(1, np.uint64)


def release() -> None:
    """Give memory that is free within the process back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """A task function that releases memory when it has ended."""

    def wrapped(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def released_group(run: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """The same for a function of a group."""

    def wrapped(group: Any) -> Any:
        try:
            return run(group)
        finally:
            release()

    return wrapped


def released_pair(run: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    """The same for a function of two groups of one key."""

    def wrapped(left: Any, right: Any) -> Any:
        try:
            return run(left, right)
        finally:
            release()

    return wrapped
