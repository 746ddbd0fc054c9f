"""Vectors of whole numbers floor(scale * x) and their exact inner products.

Products are computed in floating point where that is exact. Where it is not, floating point with a bound on its error
says which pairs can matter, and only these are computed with whole numbers of any size. Vectors are kept apart by how
large their numbers are (three classes), so that a few large ones do not slow down the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomset.llm.exchange import expand, squeeze

#: Classes: below 2 ** 22, below 2 ** 62, and all other finite numbers.
SMALL, MIDDLE = float(1 << 22), float(1 << 62)
_KINDS = (np.int16, np.int32, np.int64)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def finite_rows(vectors: pa.Array, scale: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(length, class, rows, components) of the vectors that are not null and hold neither null nor non-finite components."""
    present = np.flatnonzero(~vectors.is_null().to_numpy(zero_copy_only=False))
    if not len(present):
        return
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    present = present[bad[offsets[present + 1]] == bad[offsets[present]]]
    lengths = offsets[present + 1] - offsets[present]
    for length in np.unique(lengths):
        rows = present[lengths == length]
        x = values[offsets[rows][:, None] + np.arange(length)]
        with np.errstate(over="ignore"):
            size = np.abs(x * scale).max(axis=1, initial=0)
        kind = (size >= SMALL).astype(int) + (size >= MIDDLE)
        for k in np.unique(kind):
            yield int(length), int(k), rows[kind == k], x[kind == k]


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where a number is too large for that."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if (np.abs(v) < MIDDLE).all():
        return v.astype(np.int64)
    exact = [math.floor(c * scale) if math.isfinite(c * scale) else int(c) * int(scale) for c in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def to_blob(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, scale: float) -> bytes:
    v = whole(x, scale)
    if v.dtype == object:
        return squeeze(np.array([3, x.shape[1]], np.int64), ids, labels, np.ascontiguousarray(x))
    largest = int(np.abs(v).max(initial=0))
    kind = next(k for k, t in enumerate(_KINDS) if largest <= np.iinfo(t).max)
    return squeeze(np.array([kind, x.shape[1]], np.int64), ids, labels, v.astype(_KINDS[kind]))


def of_blob(blob: bytes, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole-number vectors."""
    kind, width = expand(blob, np.int64)[0].tolist()
    _, ids, labels, v = expand(blob, np.int64, np.int64, np.int64, np.float64 if kind == 3 else _KINDS[kind])
    v = v.reshape(len(ids), width)
    return ids, labels, whole(v, scale) if kind == 3 else v.astype(np.int64)


def _largest(v: np.ndarray) -> int:
    return max((abs(x) for x in v.ravel().tolist()), default=0) if v.dtype == object else int(np.abs(v).max(initial=0))


def below(value: int) -> float:
    """The number itself as a float, or the next one below it that there is."""
    try:
        out = float(value)
    except OverflowError:
        return math.inf if value < 0 else np.finfo(np.float64).max
    return out if out <= value else float(np.nextafter(out, -math.inf))


class Products:
    """Inner products of the rows of ``left`` with those of ``right``, which may be given block by block."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.length = left.shape[1]
        weight = _largest(left) * _largest(right) * max(1, self.length)
        self.exact = weight < 1 << 53
        self.fits = weight < 1 << 63
        kind = np.float32 if weight < 1 << 24 else np.float64
        self.plain = weight < 1 << 1000  # within the range of floats
        self._left = left.astype(kind) if self.plain else None
        self._right = right.astype(kind) if self.plain else None

    def at_least(self, rows: np.ndarray, first: int, last: int, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, place in ``right``, product) of all pairs with low <= product <= high.

        ``low`` and ``high`` are floats per row; beyond 2 ** 53 they are taken as bounds that may let more pairs pass.
        """
        if not self.plain:
            q, c = (x.ravel() for x in np.indices((len(rows), last - first)))
            return q, c + first, self._whole(rows[q], c + first)
        score = self._left[rows] @ self._right[first:last].T
        if self.exact:
            held = score >= low[:, None]
            if high is not None:
                held &= score <= high[:, None]
            q, c = np.nonzero(held)
            return q, c + first, score[q, c].astype(np.int64)
        size = np.abs(self._left[rows]) @ np.abs(self._right[first:last]).T
        error = size * ((self.length + 4) * 2.0**-52)
        held = score + error >= low[:, None]
        if high is not None:
            held &= score - error <= high[:, None]
        q, c = np.nonzero(held)
        return q, c + first, self._whole(rows[q], c + first)

    def _whole(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if self.fits and self.left.dtype != object and self.right.dtype != object:
            return (self.left[rows] * self.right[columns]).sum(axis=1)
        out = np.empty(len(rows), object)
        step = max(1, (1 << 18) // max(1, self.length))
        for at in range(0, len(rows), step):
            a, b = self.left[rows[at : at + step]].astype(object), self.right[columns[at : at + step]].astype(object)
            out[at : at + step] = (a * b).sum(axis=1) if self.length else 0
        return out


def best(key: np.ndarray, number: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each key in order: by score descending, then number."""
    if score.dtype == object:
        order = np.array(sorted(range(len(key)), key=lambda i: (key[i], -score[i], number[i])), np.int64)
    else:
        order = np.lexsort((number, -score, key))
    key, number, score = key[order], number[order], score[order]
    keep = np.arange(len(key)) - np.searchsorted(key, key) < k
    return key[keep], number[keep], score[keep]


def raise_kth(kth: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> None:
    """Write the kth score of each key that has k rows into ``kth`` (float bounds), given what :func:`best` returns."""
    full = np.arange(len(key)) - np.searchsorted(key, key) == k - 1
    found = [below(s) for s in score[full].tolist()]
    kth[key[full]] = np.maximum(kth[key[full]], np.array(found, np.float64))


def as_longs(score: np.ndarray) -> list[int | None]:
    """Scores as longs; null where one lies under all longs, an error where one lies above."""
    if score.dtype != object:
        return score.tolist()
    out = []
    for s in score.tolist():
        if s > HIGHEST:
            raise OverflowError(f"the inner product {s} does not fit a 64-bit integer")
        out.append(s if s >= LOWEST else None)
    return out


def gathered(batches: Iterator[pa.RecordBatch], scale: float, size: int) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """((length, class), ids, labels, components) of at most ``size`` vectors together, from the columns ``id``, ``vector``
    and, if there is one, ``label``; rows without an id or label are left out."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    count: dict[tuple[int, int], int] = {}

    def joined(key: tuple[int, int]):
        del count[key]
        ids, labels, x = (np.concatenate(part) for part in zip(*held.pop(key)))
        return key, ids, labels, x

    for batch in batches:
        labelled = "label" in batch.schema.names
        there = batch["id"].is_valid().to_numpy(zero_copy_only=False)
        ids = batch["id"].fill_null(0).to_numpy()
        labels = batch["label"].fill_null(0).to_numpy() if labelled else np.zeros(len(ids), np.int64)
        if labelled:
            there = there & batch["label"].is_valid().to_numpy(zero_copy_only=False)
        for width, kind, rows, x in finite_rows(batch["vector"], scale):
            own = there[rows]
            rows, x = rows[own], x[own]
            key, at = (width, kind), 0
            while at < len(rows):
                take = min(len(rows) - at, size - count.get(key, 0))
                part = slice(at, at + take)
                held.setdefault(key, []).append((ids[rows[part]], labels[rows[part]], x[part]))
                count[key] = count.get(key, 0) + take
                at += take
                if count[key] >= size:
                    yield joined(key)
    for key in list(held):
        yield joined(key)
