"""Words of many texts at once: where they start, which text they are in, and a 64-bit hash of each, in NumPy.

A word's hash is the sum of (byte + 1) * P**place over its bytes modulo 2**64, taken from running sums and shifted back
to place 0 by the inverse of P, then mixed. Such sums collide on certain patterns of a thousand bytes and more, so words
over ``LONG`` bytes get XXH64 instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

P = 0x9E3779B97F4A7C15 | 1
LONG = 256
#: Texts are handled in groups of about so many bytes; a longer text is cut at white space.
GROUP = 1 << 20

_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(1, 257, dtype=np.uint64)
for _low, _high, _as in ((0x61, 0x7A, 0x61), (0x80, 0xFF, 0x61), (0x41, 0x5A, 0x41), (0x30, 0x39, 0x30)):
    _CLASS[_low : _high + 1] = _as + 1
_RUNS = np.isin(_CLASS, [0x62, 0x42, 0x31])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(P, 1 << 16), _powers(pow(P, -1, 1 << 64), 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _BACK
    if n > len(_POWER):
        _POWER, _BACK = _powers(P, 2 * n), _powers(pow(P, -1, 1 << 64), 2 * n)
    return _POWER, _BACK


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def groups(texts: list[bytes], size: int = GROUP) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts' numbers and pieces, in groups of about ``size`` bytes; long texts come in pieces cut at white space."""
    numbers: list[int] = []
    pieces: list[bytes] = []
    held = 0
    for number, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > size:
                end = at + size
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
            numbers.append(number)
            pieces.append(text[at:end] if at or end < len(text) else text)
            held += end - at
            at = end
            if held >= size:
                yield numbers, pieces
                numbers, pieces, held = [], [], 0
            if at >= len(text):
                break
    if pieces:
        yield numbers, pieces


def words(pieces: list[bytes], shapes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For the words of all pieces in order: the piece each is in, its hash, and with ``shapes`` the hash of its shape."""
    data = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(p) + 1 for p in pieces])
    piece = np.searchsorted(ends, start, side="right")
    power, back = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * back[start])
    for k in np.flatnonzero(end - start > LONG):
        hashes[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    if not shapes:
        return piece, hashes, None
    kind = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_RUNS[data[1:]]
    place = np.cumsum(keep) - keep
    np.cumsum(np.where(keep, kind, np.uint64(0)) * power[place], out=total[1:])
    return piece, hashes, mix((total[end] - total[start]) * back[place[start]] + np.uint64(1))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(P) + right)
