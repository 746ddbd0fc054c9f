"""Fixed-width bit packing of whole numbers with NumPy: value k stands in bits k * width up to (k + 1) * width."""

from __future__ import annotations

import numpy as np

#: Eight values fill ``width`` whole bytes; a value touches at most eight bytes up to this width.
WIDEST = 57


def bits_for(largest: int) -> int:
    """The least width that holds all numbers from 0 to ``largest``; at least 1."""
    return max(1, int(largest).bit_length())


def n_bytes(count: int, width: int) -> int:
    return (count * width + 7) // 8


def pack(values: np.ndarray, width: int) -> bytes:
    """``values`` below 2 ** width, low bits first."""
    if not 1 <= width <= WIDEST:
        raise ValueError(f"width {width} is not from 1 to {WIDEST}")
    values = np.ascontiguousarray(values).astype(np.uint64, copy=False)
    if len(values) and int(values.max()) >> width:
        raise ValueError(f"a value does not fit {width} bits")
    n = len(values)
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    grouped = np.zeros((n + 7) // 8 * 8, np.uint64)
    grouped[:n] = values
    grouped = grouped.reshape(-1, 8)
    out = np.zeros((len(grouped), width), np.uint8)
    for k in range(8):
        first, shift = divmod(k * width, 8)
        moved = grouped[:, k] << np.uint64(shift)
        for b in range((width + shift + 7) // 8):
            out[:, first + b] |= (moved >> np.uint64(8 * b)).astype(np.uint8)
    return out.tobytes()[: n_bytes(n, width)]


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    """The first ``count`` values of what :func:`pack` gave, as uint64."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint64)
    groups = (count + 7) // 8
    raw = np.zeros(groups * width, np.uint8)
    have = np.frombuffer(data, np.uint8, min(len(data), len(raw)))
    raw[: len(have)] = have
    raw = raw.reshape(groups, width)
    out = np.empty((groups, 8), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        first, shift = divmod(k * width, 8)
        value = np.zeros(groups, np.uint64)
        for b in range((width + shift + 7) // 8):
            value |= raw[:, first + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]
