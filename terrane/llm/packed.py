"""Arrays as bytes that compress well, for rows that carry many values at once."""

from __future__ import annotations

import numpy as np


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte of all: high bytes first, which compress."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, ::-1].T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1)[::-1].T)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Signed numbers: their least one, then what each is above it, byte by byte of all at the width that the largest needs."""
    if not len(values):
        return b""
    least = np.int64(values.min())
    above = (values.astype("<i8") - least).view("<u8")
    width = max(1, -(-int(above.max()).bit_length() // 8))
    return least.tobytes() + np.ascontiguousarray(above.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    """The n numbers."""
    if not n:
        return np.zeros(0, np.int64)
    width = (len(data) - 8) // n
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, 8).reshape(width, n).T
    return out.view("<i8").ravel() + np.frombuffer(data, "<i8", 1)[0]
