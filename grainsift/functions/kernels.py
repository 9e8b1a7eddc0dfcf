"""Vectorised byte kernels for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, kept by name."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, (1 << 20) + 4096)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def unmix(h: np.ndarray) -> np.ndarray:
    """What ``mix`` made ``h`` of."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
        h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
        h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def plain_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each byte range, in constant time a range: differences of
    prefix sums, shifted to a common origin."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power("inv", BASE_INVERSE, len(raw)), out=sums[1:])
        return (sums[ends] - sums[starts]) * power("pow", BASE, len(raw) + 1)[starts]


def short_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``plain_hashes`` of all ranges of two bytes and of three, by place."""
    with np.errstate(over="ignore"):
        value = raw.astype(np.uint64) + np.uint64(1)
        two = value[:-1] + value[1:] * BASE_INVERSE
        return two, two[:-1] + value[2:] * (BASE_INVERSE * BASE_INVERSE)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return mix(plain_hashes(raw, starts, ends))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and n + 1 offsets into them. Null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together (one text at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
