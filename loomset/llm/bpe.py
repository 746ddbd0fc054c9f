"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

A pre-token starts as its bytes, linked left and right. Every adjacent pair that has a merge enters a heap by
(rank, place). The lowest entry is popped; it is stale, and skipped, if one of its two symbols has gone or has changed
since. Otherwise the right symbol is unlinked, the left becomes the merged one, and the two new neighbour pairs enter
the heap. A pre-token of n bytes takes O(n log n), so an unbroken run of megabytes does not turn quadratic. Decoding
concatenates the vocabulary's byte strings.

Texts are encoded whole and independently of each other (no shuffle). Every worker keeps the ids of at most ``CACHE``
pre-tokens.

Defined cases: a null or empty text has no ids; repeated rows give repeated rows; a special token's string inside a text
is its id, as the vocabulary file declares; bytes that are not UTF-8 count as U+FFFD; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from array import array
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame

from loomset.llm.bytelevel import PAIR_SHIFT, Bounded, Vocabulary
from loomset.llm.common import as_text, doc_bytes, map_rows, spread

CACHE = 500_000
LONG_WORD = 64
PLACE_BITS = 40
PLACE_MASK = (1 << PLACE_BITS) - 1


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        self.vocabulary = Vocabulary(path)
        self._packed = Bounded(self._pack, cache)
        self._bytes = self.vocabulary.bytes_of
        self._byte_id = self.vocabulary.byte_id

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token, by merging its linked bytes in order of rank. Heap entries are rank << PLACE_BITS | place."""
        rank_of, merged = self.vocabulary.rank_of, self.vocabulary.merged
        symbol = [self._byte_id[b] for b in data]
        n = len(symbol)
        heap = [
            rank << PLACE_BITS | at
            for at, (a, b) in enumerate(zip(symbol, symbol[1:]))
            if (rank := rank_of.get(a << PAIR_SHIFT | b)) is not None
        ]
        if not heap:
            return symbol
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbol.append(-1)  # stands after the last one and never merges
        while heap:
            entry = heapq.heappop(heap)
            at, rank = entry & PLACE_MASK, entry >> PLACE_BITS
            own, right = symbol[at], after[at]
            if own < 0 or (other := symbol[right]) < 0 or rank_of.get(own << PAIR_SHIFT | other) != rank:
                continue  # stale: one side has gone or has been merged since
            symbol[at], symbol[right] = own, _ = merged[rank], -1
            beyond, left = after[right], before[at]
            after[at] = beyond
            if beyond < n:
                before[beyond] = at
                if (rank := rank_of.get(own << PAIR_SHIFT | symbol[beyond])) is not None:
                    heapq.heappush(heap, rank << PLACE_BITS | at)
            if left >= 0 and (rank := rank_of.get(symbol[left] << PAIR_SHIFT | own)) is not None:
                heapq.heappush(heap, rank << PLACE_BITS | left)
        return [s for s in symbol if s >= 0]

    def _pack(self, word: str) -> bytes:
        special = self.vocabulary.special.get(word)
        ids = array("I", [special] if special is not None else self.encode_bytes(word.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        words = self.vocabulary.pretokens(text)
        if words and max(map(len, words)) > LONG_WORD:  # long runs are not kept
            return b"".join(self._packed[w] if len(w) <= LONG_WORD else self._pack(w) for w in words)
        return b"".join(map(self._packed.__getitem__, words))

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def unpack(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def encode_documents(docs: DataFrame, vocabulary: str, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``ids_sha256`` (ids as little-endian uint32), ``decoded_sha256``; with
    ``with_text`` also ``ids`` and the ``decoded`` text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>, decoded string" if with_text else ""

    def step(batch: dict[str, list]) -> dict[str, list]:
        enc = encoder(vocabulary)
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        out["doc_id"] = batch["doc_id"]
        for data in batch["data"]:
            packed = enc.encode(as_text(data))
            ids = unpack(packed)
            decoded = enc.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_text:
                out["ids"].append(list(ids))
                out["decoded"].append(decoded)
        return out

    return map_rows(spread(doc_bytes(docs)), schema, step)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``ids`` (null: empty) to ``doc_id`` and ``text``."""

    def step(batch: dict[str, list]) -> dict[str, list]:
        enc = encoder(vocabulary)
        return {"doc_id": batch["doc_id"], "text": [enc.decode(ids or []) for ids in batch["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", step)
