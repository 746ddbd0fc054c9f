"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

The probability of a token w behind h is l2 * c(h w)/c(h) + l1 * c(w)/N + l0 / (V + 1); the last part is uniform over
the V known tokens and one slot for all unknown ones. The weights depend on the bucket of the context's frequency (the
binary magnitude of c(h)) and are learned by expectation-maximisation on held-out counts, each training token in turn
being the one held out: it is taken out of all counts before they predict it.

Counts cover every training document. Texts are tokenised once into packs (distinct words and token numbers,
compressed). Each pack asks the buckets of a hash for the counts of its distinct words and word pairs and gets them back
in order, so a word that is everywhere is one entry per pack; no table of counts is broadcast or joined row by row. For
the maximisation a token only matters by its bucket and its two held-out estimates; these are counted on a grid of
quarter powers of two, at most 32 * 192 * 192 cells, which is what the driver gets.

Defined cases: a null or empty text is its end token; repeated rows count and are scored as often as they come; without
training documents the base and the model score every token 1 in V + 1 = 1; an empty table gives no rows; a null doc_id
counts as the empty id when documents are dealt out; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import arrow_schema, doc_bytes, materialise, parts_for, spread
from loomset.llm.exchange import (
    EXCHANGE,
    batch_rows,
    by_pack,
    exchange_batch,
    expand,
    from_planes,
    pack_sorted,
    planes,
    squeeze,
    unpack_sorted,
)
from loomset.llm.wordhash import groups, pair_hash, words

PACK = 8 << 20
BUCKET = 24 << 20
#: Bytes of a hash that are exchanged (beside its bucket): for single words and for pairs.
WORD_BYTES, PAIR_BYTES = 6, 5
END, START = np.uint64(1), np.uint64(2)
GRID, LEVELS, MAGNITUDES = 4, 192, 32
ROUNDS = 200
LEAST = 1e-7

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Packing:
    """Collects documents and turns them into one row."""

    def __init__(self) -> None:
        self.ids: list = []
        self.held: list[bool] = []
        self.texts: list[bytes] = []
        self.size = 0

    def add(self, doc_id, held: bool, text: bytes) -> None:
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(text.lower())  # bytes: A-Z only
        self.size += len(text)

    def row(self) -> pa.RecordBatch:
        text, token = [], []
        for numbers, pieces in groups(self.texts):
            piece, found, _ = words(pieces)
            text.append(np.asarray(numbers)[piece])
            token.append(found)
        n = len(self.ids)
        text.append(np.arange(n))
        token.append(np.full(n, END))  # one behind each text
        text, token = np.concatenate(text), np.concatenate(token)
        order = np.argsort(text, kind="stable")
        known, number = np.unique(token[order] >> np.uint64(8), return_inverse=True)  # 56 bits
        counts = np.bincount(text, minlength=n)
        held = np.array(self.held, bool)
        train = int(counts[~held].sum())
        common = np.argsort(-np.bincount(number, minlength=len(known)), kind="stable")
        place = np.empty(len(known), np.int64)
        place[common] = np.arange(len(known))
        null = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        blob = squeeze(ids, null, held.astype(np.uint8), counts, pack_sorted(known, 7), planes(common, 4), planes(place[number], 4))
        return pa.RecordBatch.from_arrays([pa.array([self.size], pa.int64()), pa.array([train], pa.int64()), pa.array([blob], pa.binary())], names=["size", "train", "blob"])


def packs(docs: DataFrame, held_out: Column) -> DataFrame:
    """``pack, size, train, blob``: documents of about ``PACK`` bytes together, tokenised."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Packing()
        for batch in batches:
            for doc_id, held, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["data"]):
                packing.add(doc_id, bool(held), text.as_py())
                if packing.size >= PACK:
                    yield packing.row()
                    packing = Packing()
        if packing.ids:
            yield packing.row()

    rows = doc_bytes(spread(docs.select("doc_id", "text")), held_out.alias("held_out"))
    return materialise(rows.mapInArrow(fill, "size long, train long, blob binary").withColumn("pack", F.monotonically_increasing_id()))


class Pack:
    """A pack unfolded: tokens and pairs of all its texts in order, and its distinct keys in the order of the exchange."""

    def __init__(self, blob: bytes, buckets: int):
        ids, null, held, counts, known, common, number = expand(blob, np.int64, np.uint8, np.uint8, np.int64, np.uint8, np.uint8, np.uint8)
        self.ids = [None if n else i for i, n in zip(ids.tolist(), null.tolist())]
        self.held, self.counts = held.astype(bool), counts
        key = unpack_sorted(known, 7)  # ascending
        common = from_planes(common, 4).astype(np.int64)
        self.token = common[from_planes(number, 4).astype(np.int64)]
        self.first = np.cumsum(counts) - counts  # the first token of each text
        self.before = np.empty(len(self.token), np.int64)
        self.before[1:] = self.token[:-1]
        self.before[self.first] = -1  # START
        left = np.where(self.before < 0, START, key[self.before])
        pair, self.pair = np.unique(pair_hash(left, key[self.token]), return_inverse=True)
        self.end = int(np.searchsorted(key, END >> np.uint64(8))) if len(key) else 0
        self.word_order, self.word_keys, self.word_bounds = _by_bucket(key << np.uint64(8), buckets, WORD_BYTES)
        self.pair_order, self.pair_keys, self.pair_bounds = _by_bucket(pair, buckets, PAIR_BYTES)
        self.train = np.repeat(~self.held, counts)

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """Per bucket: the keys, ascending, and how often the pack's training texts have them."""
        word_count = np.bincount(self.token[self.train], minlength=len(self.word_order))[self.word_order]
        pair_count = np.bincount(self.pair[self.train], minlength=len(self.pair_order))[self.pair_order]
        for b in range(len(self.word_bounds) - 1):
            w, p = slice(*self.word_bounds[b : b + 2]), slice(*self.pair_bounds[b : b + 2])
            if w.start < w.stop or p.start < p.stop:
                yield b, squeeze(
                    pack_sorted(self.word_keys[w], WORD_BYTES), planes(word_count[w], 4), pack_sorted(self.pair_keys[p], PAIR_BYTES), planes(pair_count[p], 4)
                )

    def answers(self, blobs: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts in all training texts of the pack's distinct words and pairs."""
        word, pair = np.zeros(len(self.word_order), np.int64), np.zeros(len(self.pair_order), np.int64)
        self.distinct: dict[int, int] = {}  # distinct training words of each bucket
        for b, blob in blobs.items():
            w, p, distinct = expand(blob, np.uint8, np.uint8, np.int64)
            self.distinct[b] = int(distinct[0])
            word[self.word_order[slice(*self.word_bounds[b : b + 2])]] = from_planes(w, 5).astype(np.int64)
            pair[self.pair_order[slice(*self.pair_bounds[b : b + 2])]] = from_planes(p, 5).astype(np.int64)
        return word, pair


def _by_bucket(key: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the keys by (bucket, exchanged part), those parts in that order, and the bounds of the buckets."""
    bucket = (key >> np.uint64(8)) % np.uint64(buckets)
    part = (key >> np.uint64(8)) // np.uint64(buckets) & np.uint64((1 << 8 * width) - 1)
    order = np.lexsort((part, bucket))
    return order, part[order], np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))


def _requests(packed: DataFrame, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in batch_rows(batch, "pack", "blob"):
                yield exchange_batch(number, list(Pack(blob, buckets).requests()))

    return packed.select("pack", "blob").mapInArrow(send, EXCHANGE)


def _total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For each list of keys their counts over all lists, and the number of distinct keys with a count."""
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, inverse, np.concatenate(counts).astype(np.int64))
    return np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1]), int((total > 0).sum())


def _answers(requests: DataFrame) -> DataFrame:
    """The answer to each request: the counts of its keys, and the number of distinct training words in the bucket."""

    def count(table: pa.Table) -> pa.Table:
        parts = [expand(blob.as_py(), np.uint8, np.uint8, np.uint8, np.uint8) for blob in table["blob"]]
        word, distinct = _total([unpack_sorted(p[0], WORD_BYTES) for p in parts], [from_planes(p[1], 4) for p in parts])
        pair, _ = _total([unpack_sorted(p[2], PAIR_BYTES) for p in parts], [from_planes(p[3], 4) for p in parts])
        blobs = [squeeze(planes(w, 5), planes(p, 5), np.array([distinct], np.int64)) for w, p in zip(word, pair)]
        return pa.table([table["pack"], table["bucket"], pa.array(blobs, pa.binary())], names=["pack", "bucket", "blob"])

    return requests.groupBy("bucket").applyInArrow(count, EXCHANGE)


class Estimates:
    """A pack's tokens with their counts."""

    def __init__(self, blob: bytes, parts: list[dict], buckets: int):
        self.pack = Pack(blob, buckets)
        word, pair = self.pack.answers({p["bucket"]: p["blob"] for p in parts or []})
        self.one = word[self.pack.token]
        self.two = pair[self.pack.pair]
        documents = word[self.pack.end] if len(word) else 0  # as often as texts end, they start
        self.context = np.where(self.pack.before < 0, documents, word[self.pack.before])


def _magnitude(count: np.ndarray) -> np.ndarray:
    """0 for 0, else the number of binary digits."""
    return np.minimum(np.frexp(count.astype(float))[1] * (count > 0), MAGNITUDES - 1).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + the number of quarter halvings from 1."""
    safe = np.where(p > 0, p, 1.0)
    return np.where(p > 0, np.minimum(1 + np.round(-GRID * np.log2(safe)), LEVELS - 1), 0).astype(np.int64)


def _divide(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _grid(joined: DataFrame, buckets: int, tokens: int) -> DataFrame:
    """``cell, n``: training tokens by context bucket and held-out estimates; -1 - b: distinct training words of bucket b."""
    schema = "cell long, n long"
    target = arrow_schema(joined.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, parts in batch_rows(batch, "blob", "parts"):
                e = Estimates(blob, parts, buckets)
                own = e.pack.train
                one, two, context = e.one[own] - 1, e.two[own] - 1, e.context[own] - 1
                cell = (_magnitude(context) * LEVELS + _level(_divide(two, context))) * LEVELS + _level(_divide(one, max(tokens - 1, 0)))
                found, n = np.unique(cell, return_counts=True)
                found = np.concatenate([found, [-1 - b for b in e.pack.distinct]]).astype(np.int64)
                n = np.concatenate([n, list(e.pack.distinct.values())]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], schema=target)

    return joined.select("blob", "parts").mapInArrow(count, schema).groupBy("cell").agg(F.expr("if(cell < 0, max(n), sum(n)) AS n"))


def mixture_weights(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (pair, word, uniform) per context bucket, by expectation-maximisation on the grid of held-out estimates."""
    level = np.arange(LEVELS)
    estimate = np.where(level > 0, 2.0 ** (-(level - 1) / GRID), 0.0)
    bucket = cells // (LEVELS * LEVELS)
    p = np.stack([estimate[cells // LEVELS % LEVELS], estimate[cells % LEVELS], np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
    weights = np.full((MAGNITUDES, 3), 1 / 3)
    for _ in range(rounds):
        joint = weights[bucket] * p
        share = joint / joint.sum(1, keepdims=True) * n[:, None]
        gathered = np.stack([np.bincount(bucket, share[:, k], MAGNITUDES) for k in range(3)], axis=1)
        total = gathered.sum(1, keepdims=True)
        after = np.where(total > 0, gathered / np.maximum(total, 1e-300), weights)
        if np.abs(after - weights).max() < 1e-9:
            break
        weights = after
    seen = np.bincount(bucket, n, MAGNITUDES) > 0
    for k in range(MAGNITUDES):  # a bucket without tokens takes the weights of the nearest below, or of the first above
        if not seen[k]:
            near = [j for j in range(k - 1, -1, -1) if seen[j]] or [j for j in range(k + 1, MAGNITUDES) if seen[j]]
            weights[k] = weights[near[0]] if near else (0, 0, 1)
    weights[0, 1] += weights[0, 0]  # an unknown context has no pair estimate
    weights[0, 0] = 0
    weights = np.maximum(weights, [0, LEAST, LEAST])
    return weights / weights.sum(1, keepdims=True)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    packed = packs(docs, held_out)
    size, tokens = (x or 0 for x in packed.agg(F.sum("size"), F.sum("train")).first())
    buckets = parts_for(size, BUCKET, 24)
    answers = by_pack(_answers(_requests(packed, buckets)), "parts")
    joined = materialise(packed.select("pack", "blob").join(answers, "pack"))
    found = _grid(joined, buckets, tokens).collect()  # at most MAGNITUDES * LEVELS ** 2 rows and one per bucket
    vocabulary = sum(n for cell, n in found if cell < 0)
    cells = [row for row in found if row[0] >= 0]
    weights = mixture_weights(np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], float), vocabulary)
    target = arrow_schema(docs.sparkSession, RESULT)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, parts in batch_rows(batch, "blob", "parts"):
                e = Estimates(blob, parts, buckets)
                w = weights[np.where(e.context > 0, _magnitude(e.context), 0)]
                p = w[:, 0] * _divide(e.two, e.context) + w[:, 1] * _divide(e.one, tokens) + w[:, 2] / (vocabulary + 1)
                base = np.log10(e.one + 1) - np.log10(tokens + vocabulary + 1)
                first = e.pack.first
                columns = [
                    pa.array(e.pack.ids, pa.int64()),
                    pa.array(e.pack.held),
                    pa.array(e.pack.counts),
                    pa.array(np.add.reduceat((e.one > 0).astype(np.int64), first)),
                    pa.array(np.full(len(first), tokens, np.int64)),
                    pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(np.log10(p), first)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return joined.select("blob", "parts").mapInArrow(judge, RESULT)
