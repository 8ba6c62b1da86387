"""64-bit hash mixing, and compact bytes for integer arrays."""

from __future__ import annotations

import numpy as np
import zstandard

#: Odd 64-bit constants for multiplicative mixing.
ODD_A, ODD_B, ODD_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed_hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD_B
    x = (x ^ (x >> np.uint64(27))) * ODD_C
    return x ^ (x >> np.uint64(31))


def pack_numbers(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, byte planes apart."""
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.itemsize).T if len(v) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their differences."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, np.uint64), dtype=np.uint64)
