"""Vectorised text kernels over Arrow buffers: token spans, XXH64, grouped sums.

Every kernel works on one flat byte buffer with document offsets, so that its
cost is a few numpy passes per byte and its memory a small multiple of one
slice (``slices`` bounds a slice by bytes; a longer document is its own slice).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

_U = np.uint64
# The five primes of the public XXH64 specification.
P1 = _U(0x9E3779B185EBCA87)
P2 = _U(0xC2B2AE3D27D4EB4F)
P3 = _U(0x165667B19E3779F9)
P4 = _U(0x85EBCA77C2B2AE63)
P5 = _U(0x27D4EB2F165667C5)

SPACE, LETTER, DIGIT, SYMBOL = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Byte classes: ASCII white space, letters (and all bytes of multi-byte characters), digits, the rest."""
    table = np.full(256, SYMBOL, dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[ord("0") : ord("9") + 1] = DIGIT
    table[ord("A") : ord("Z") + 1] = LETTER
    table[ord("a") : ord("z") + 1] = LETTER
    table[128:] = LETTER
    return table


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.cast(pa.binary()).fill_null(b"")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def runs(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one class that do not cross documents, without class 0: start, end, class, document."""
    n = len(classes)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint8), none
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(classes[1:], classes[:-1], out=edge[1:])
    heads = offsets[:-1]
    edge[heads[heads < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    kind = classes[starts]
    keep = kind != 0
    starts, ends, kind = starts[keep], ends[keep], kind[keep]
    return starts, ends, kind, np.searchsorted(offsets, starts, side="right") - 1


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's words joined by one space (words: runs without ASCII white space)."""
    n = len(data)
    if n == 0:
        return data, offsets
    blank = CLASS[data] == SPACE
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = True
    keep = ~(blank & before)
    out = np.where(blank, np.uint8(32), data)[keep]
    kept = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out, kept[offsets]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _view(data: np.ndarray, width: int) -> np.ndarray:
    """Every unaligned little-endian word of ``width`` bytes of a padded buffer."""
    return np.ndarray((len(data) - width + 1,), f"<u{width}", data.data, strides=(1,))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every byte span, as unsigned 64-bit integers."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    w8, w4 = _view(padded, 8), _view(padded, 4)
    length = ends - starts
    order = np.argsort(np.minimum(length, 32).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(np.minimum(length, 32)[order], np.arange(34))
    with np.errstate(over="ignore"):
        for n in range(32):
            rows = order[bounds[n] : bounds[n + 1]]
            if not len(rows):
                continue
            at = starts[rows]
            h = np.full(len(rows), _U(seed) + P5 + _U(n), np.uint64)
            step = 0
            while step + 8 <= n:
                h ^= _rotl(w8[at + step] * P2, 31) * P1
                h = _rotl(h, 27) * P1 + P4
                step += 8
            if step + 4 <= n:
                h ^= w4[at + step].astype(np.uint64) * P1
                h = _rotl(h, 23) * P2 + P3
                step += 4
            while step < n:
                h ^= padded[at + step].astype(np.uint64) * P5
                h = _rotl(h, 11) * P1
                step += 1
            h ^= h >> _U(33)
            h *= P2
            h ^= h >> _U(29)
            h *= P3
            h ^= h >> _U(32)
            out[rows] = h
    rows = order[bounds[32] :]
    if len(rows):
        held = data.tobytes()
        digest = xxhash.xxh64_intdigest
        out[rows] = [digest(held[a:b], seed) for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
    return out


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    with np.errstate(over="ignore"):
        h = _rotl(left * P2, 31) * P1 ^ right
        h = _rotl(h, 27) * P1 + P4
        return h ^ (h >> _U(29))


def group_sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Float sums by group number."""
    return np.bincount(group, weights=values, minlength=groups)[:groups]


def crc32_text(value: object) -> int:
    """CRC-32 of a value's decimal or other text."""
    return zlib.crc32(str(value).encode())
