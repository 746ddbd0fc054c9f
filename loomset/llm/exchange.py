"""Exchange between packs of documents and buckets of keys: one compressed blob for each pack and bucket.

A pack is a row that holds a few megabytes of documents. It sends every bucket the keys it has there; a bucket answers
each pack in the order of the pack's keys. So the exchanged bytes are those of the distinct keys per pack, however often
a key occurs in the pack, and a key that is everywhere has as many entries in its bucket as there are packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCHANGE = "pack long, bucket int, blob binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def expand(blob: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def batch_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        yield tuple(batch[n][k].as_py() for n in names)


def exchange_batch(pack: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([pack] * len(blobs), pa.int64()), pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["pack", "bucket", "blob"])


def by_pack(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("pack").agg(F.collect_list(F.struct("bucket", "blob")).alias(name))  # one row per bucket at most


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers below 256 ** width as byte planes, low bytes first, which compress better than whole numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def from_planes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray, width: int) -> np.ndarray:
    """Ascending numbers below 256 ** width as planes of their differences."""
    return planes(np.diff(values, prepend=np.uint64(0)), width)


def unpack_sorted(data: np.ndarray, width: int) -> np.ndarray:
    return np.cumsum(from_planes(data, width), dtype=np.uint64)
