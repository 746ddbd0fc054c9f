"""Counting quotient filters over invertibly permuted keys: exact multisets in little space.

A key is a row of ``lanes``, numbers of ``width`` bits each, such as the word ids of an n-gram. A keyless permutation of
all its bits (each lane in turn gets a mix of the others added, modulo its range) makes keys even; it can be undone, so
nothing is lost. The permuted bits, joined into limbs of at most 57 bits, are cut into a quotient, the first q bits, and
a remainder, all the rest. A filter of 2 ** q quotients is the sorted list of its keys laid out in slots: a key's slot is
its quotient's own or the next free one behind it; one bit per quotient says whether it occurs, one bit per slot whether
a run of equal quotients ends there, and a slot holds the remainder in its exact number of bits. Counters take one byte;
those from 255 on stand in a list of their own. Equal remainders are one entry, so counts are exact at any size.

Filters of many shards that hold the same range of permuted keys are merged like sorted lists.
"""

from __future__ import annotations

import numpy as np

from loomset.llm import bitpack
from loomset.llm.exchange import expand, squeeze
from loomset.llm.wordhash import mix

LIMB = bitpack.WIDEST
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _rounds(lanes: int) -> int:
    return max(4, 2 * lanes)


def _drawn(lanes: np.ndarray, own: int, step: int, mask: np.uint64) -> np.ndarray:
    total = np.full(lanes.shape[1], (step + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1, np.uint64)
    for k in range(len(lanes)):
        if k != own:
            total = mix(total + lanes[k] * _ODD[k % len(_ODD)] + np.uint64(k))
    return total & mask


def permute(lanes: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """The keys (one a column) permuted, or with ``back`` the keys that were."""
    lanes, mask = lanes.astype(np.uint64), np.uint64((1 << width) - 1)
    steps = range(_rounds(len(lanes)))
    for step in reversed(steps) if back else steps:
        own = step % len(lanes)
        drawn = _drawn(lanes, own, step, mask)
        lanes[own] = (lanes[own] - drawn if back else lanes[own] + drawn) & mask
    return lanes


def limb_bits(lanes: int, width: int) -> list[int]:
    together = max(1, LIMB // width)
    return [width * min(together, lanes - k) for k in range(0, lanes, together)]


def to_limbs(lanes: np.ndarray, width: int) -> list[np.ndarray]:
    together, out = max(1, LIMB // width), []
    for k in range(0, len(lanes), together):
        limb = np.zeros(lanes.shape[1], np.uint64)
        for lane in lanes[k : k + together]:
            limb = limb << np.uint64(width) | lane
        out.append(limb)
    return out


def of_limbs(limbs: list[np.ndarray], lanes: int, width: int) -> np.ndarray:
    together, out, mask = max(1, LIMB // width), [], np.uint64((1 << width) - 1)
    for limb, k in zip(limbs, range(0, lanes, together)):
        held = min(together, lanes - k)
        out += [limb >> np.uint64(width * (held - 1 - j)) & mask for j in range(held)]
    return np.stack(out)


def counted(limbs: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct keys, their total counts, and each given key's place among them."""
    n = len(limbs[0])
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs = [limb[order] for limb in limbs]
    opens = np.ones(n, bool)
    if n:
        opens[1:] = np.logical_or.reduce([limb[1:] != limb[:-1] for limb in limbs])
    first = np.flatnonzero(opens)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(opens) - 1
    given = np.ones(n, np.int64) if counts is None else counts.astype(np.int64)[order]
    total = np.add.reduceat(given, first) if n else given
    return [limb[first] for limb in limbs], total, place


def bounds(head: np.ndarray, bits: int, range_bits: int) -> np.ndarray:
    """Where each of the 2 ** range_bits ranges of the first limb's sorted values begins, and the end."""
    edges = np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits)
    return np.append(np.searchsorted(head, edges), len(head))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def filter_blob(limbs: list[np.ndarray], counts: np.ndarray, bits: list[int], range_bits: int) -> bytes:
    """The filter of sorted distinct keys that agree in their first ``range_bits`` bits."""
    n, free = len(counts), bits[0] - range_bits
    head = limbs[0] & _mask(free)
    q = min(free, max(1, int(n - 1).bit_length()))
    quotient = (head >> np.uint64(free - q)).astype(np.int64)
    index = np.arange(n)
    slot = index + np.maximum.accumulate(quotient - index)
    slots = max(1 << q, int(slot[-1]) + 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.zeros(slots, bool)
    ends[slot[np.append(quotient[1:] != quotient[:-1], True)]] = True
    stored = []
    for values, width in zip([head & _mask(free - q), *limbs[1:]], [free - q, *bits[1:]]):
        held = np.zeros(slots, np.uint64)
        held[slot] = values
        stored.append(np.frombuffer(bitpack.pack(held, width), np.uint8) if width else np.zeros(0, np.uint8))
    small = np.minimum(counts - 1, 255).astype(np.uint8)
    large = counts[small == 255].astype(np.int64)
    return squeeze(np.array([q, slots], np.int64), np.packbits(occupied), np.packbits(ends), small, large, *stored)


def of_filter(blob: bytes, bits: list[int], range_bits: int, number: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted keys of the filter of range ``number``, and their counts."""
    parts = expand(blob, np.int64, np.uint8, np.uint8, np.uint8, np.int64, *[np.uint8] * len(bits))
    q, slots = parts[0].tolist()
    free = bits[0] - range_bits
    occupied = np.flatnonzero(np.unpackbits(parts[1], count=1 << q))
    ends = np.flatnonzero(np.unpackbits(parts[2], count=slots))
    starts = np.maximum(occupied, np.append(0, ends[:-1] + 1))
    lengths = ends - starts + 1
    slot = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    quotient = np.repeat(occupied, lengths).astype(np.uint64)
    widths = [free - q, *bits[1:]]
    held = [bitpack.unpack(p.tobytes(), slots, w)[slot] if w else np.zeros(len(slot), np.uint64) for p, w in zip(parts[5:], widths)]
    base = np.uint64(number << free)
    counts = parts[3].astype(np.int64) + 1
    counts[parts[3] == 255] = parts[4]
    return [base | quotient << np.uint64(free - q) | held[0], *held[1:]], counts


def merged(filters: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Keys and counts of several filters of one range together, and each filter's entries' places among them."""
    limbs = [np.concatenate(x) for x in zip(*(f[0] for f in filters))]
    keys, total, place = counted(limbs, np.concatenate([f[1] for f in filters]))
    return keys, total, np.split(place, np.cumsum([len(f[1]) for f in filters])[:-1])
