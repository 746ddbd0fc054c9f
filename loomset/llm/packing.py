"""Best-fit packing into sequences of fixed length: pattern packing by non-negative least squares.

Every document becomes the ids that the tokenizers library gives for it plus an end id. Only documents longer than a
sequence are cut, into full pieces behind a first piece with the rest, so every piece but full ones competes for room.
What packs is then the histogram of piece lengths, at most ``size`` numbers whatever the corpus:

1. patterns of one to four lengths that fill a sequence, or nearly do, are enumerated (at most ``MAX_PATTERNS``);
2. non-negative least squares fits how often each pattern is to be used so that the sums meet the histogram;
3. the counts are rounded down to what the histogram holds;
4. the residual lengths are packed by best fit, longest first, on counts, which yields more patterns.

A piece finds its place by its rank among the pieces of its length: the plan says which sequence and which offset rank k
of length n has. Ranks come from windows over (length, slice of the document hash) plus the sum of the slices before, so
a length that a third of all pieces share is spread over many tasks.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they come; an empty table
gives no rows; a null doc_id is kept; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.bytelevel import PATTERN, Vocabulary
from loomset.llm.common import arrow_schema, as_text, doc_bytes, map_rows, materialise, parts_for, spread

SIZE = 2048
END = 0
MAX_PATTERNS = 8192
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
#: A window over one length and slice holds about so many pieces.
SLICE_ROWS = 1 << 18


class Ids:
    """The ids that the tokenizers library gives with a byte-level BPE file.

    They are computed by tiktoken from the same vocabulary (a byte string's id is its merge rank), which gives equal ids
    at about a quarter of the cost. A text that its pattern engine refuses (a run of white space of some hundred
    thousand characters) goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        vocabulary = Vocabulary(path)
        special = set(vocabulary.special.values())
        ranks = {b: i for i, b in vocabulary.bytes_of.items() if i not in special}
        self.path, self._tokenizer = path, None
        self.coding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.special)

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        try:
            return self.coding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def cut_pieces(ids: bytes, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document: full pieces behind a first one that may be shorter."""
    n = len(ids) // 4
    first = n % size or min(n, size)
    bounds = [0, *range(first, n + 1, size)]
    for piece, (start, end) in enumerate(zip(bounds, bounds[1:])):
        yield piece, start, ids[4 * start : 4 * end]


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``copy`` tells repeated rows apart."""
    schema = PIECES + (", ids array<long>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def step(batch: dict[str, list]) -> dict[str, list]:
        ids = _ids(vocabulary)
        rows = []
        for doc_id, copy, data in zip(batch["doc_id"], batch["copy"], batch["data"]):
            for piece, start, part in cut_pieces(ids.encode(as_text(data)) + end, size):
                row = (doc_id, copy, piece, start, len(part) // 4, zlib.crc32(part))
                rows.append(row + ((np.frombuffer(part, "<u4").tolist(),) if with_ids else ()))
        return dict(zip((f.split()[0] for f in schema.split(", ")), map(list, zip(*rows))))

    rows = doc_bytes(spread(docs.select("doc_id", "text"))).withColumn("copy", F.monotonically_increasing_id())
    return map_rows(rows, schema, step)


# --- the plan, on the histogram of lengths ---------------------------------------------------------------------------


@dataclass
class Plan:
    """Per length the runs of ranks: first rank, first sequence, places of the length in one sequence, their offsets."""

    runs: dict[int, list[tuple[int, int, tuple[int, ...]]]]
    sequences: int


def patterns(histogram: dict[int, int], size: int = SIZE, limit: int = MAX_PATTERNS) -> list[tuple[int, ...]]:
    """Length patterns of one to four documents that fill a sequence: all singles, pairs of the 192 commonest lengths, and the likeliest of more."""
    lengths = sorted(histogram, reverse=True)
    present = np.zeros(size + 1, np.int64)
    present[lengths] = [histogram[n] for n in lengths]
    fits = np.where(present[: size + 1] > 0, np.arange(size + 1), 0)
    below = np.maximum.accumulate(fits)  # the longest present length up to n
    found: dict[tuple[int, ...], float] = {}

    def add(parts: tuple[int, ...]) -> None:
        rest = size - sum(parts)
        last = int(below[rest]) if rest > 0 else 0
        whole = tuple(sorted((*parts, last) if last else parts, reverse=True))
        waste = size - sum(whole)
        found[whole] = min(histogram[n] for n in whole) / (1 + waste)

    for a in lengths:
        add((a,))
    common = sorted(lengths, key=lambda n: (-histogram[n], n))[:192]
    for a in common:
        for b in common:
            if a >= b and a + b < size:
                add((a, b))
    few = common[:40]
    for a in few:
        for b in few:
            for c in few:
                if a >= b >= c and a + b + c < size:
                    add((a, b, c))
    return sorted(sorted(found, key=lambda p: (-found[p], p))[:limit])


def fit(histogram: dict[int, int], chosen: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 that bring the patterns' sums nearest to the histogram.

    Accelerated projected gradient; a length weighs in by its inverse root count, so rare lengths are met too.
    """
    lengths = sorted(histogram)
    row_of = {n: i for i, n in enumerate(lengths)}
    rows, cols = zip(*((row_of[n], j) for j, p in enumerate(chosen) for n in p))
    rows, cols = np.array(rows), np.array(cols)
    want = np.array([histogram[n] for n in lengths], float)
    weight = 1 / np.sqrt(want)
    scale = np.sqrt(np.bincount(cols, weight[rows] ** 2, len(chosen)))  # column norms
    value = weight[rows] / scale[cols]
    goal = want * weight
    ahead = lambda x: np.bincount(rows, value * x[cols], len(lengths))
    back = lambda r: np.bincount(cols, value * r[rows], len(chosen))
    v = np.ones(len(chosen))
    for _ in range(20):
        v = back(ahead(v))
        v /= np.linalg.norm(v)
    step = 0.95 / np.linalg.norm(back(ahead(v)))
    x = y = np.zeros(len(chosen))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, y - step * back(ahead(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = after, after + (t - 1) / t2 * (after - x), t2
    return x / scale


def best_fit(histogram: dict[int, int], size: int) -> Counter:
    """Best fit, longest first, on counts: patterns with how often each is made. Sequences alike are handled together."""
    open_at: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    rooms: list[int] = []  # the rooms with open sequences, ascending
    done: Counter = Counter()

    def put(pattern: tuple[int, ...], count: int) -> None:
        room = size - sum(pattern)
        if not open_at[room]:
            at = bisect_left(rooms, room)
            rooms.insert(at, room)
        open_at[room].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = max(1, min(left, size // length))
                full, rest = divmod(left, per)
                put((length,) * per, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[at]
            group = open_at[room][-1]
            take = min(left, group[1])
            group[1] -= take
            if not group[1]:
                open_at[room].pop()
                if not open_at[room]:
                    rooms.pop(at)
            put((*group[0], length), take)
            left -= take
    for groups in open_at.values():
        for pattern, count in groups:
            done[pattern] += count
    return done


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """How often each pattern is used, and so the place of every rank of every length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used: Counter = Counter()
    if left:
        chosen = patterns(left, size)
        times = fit(left, chosen)
        for j in sorted(range(len(chosen)), key=lambda j: (-times[j], chosen[j])):
            need = Counter(chosen[j])
            count = min(int(times[j] + 1e-6), *(left[n] // k for n, k in need.items()))
            if count > 0:
                used[chosen[j]] += count
                for n, k in need.items():
                    left[n] -= k * count
        used.update(best_fit({n: c for n, c in left.items() if c}, size))
    runs: dict[int, list] = defaultdict(list)
    rank: Counter = Counter()
    sequence = 0
    for pattern in sorted(used):
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for n in pattern:
            offsets[n].append(at)
            at += n
        for n, places in offsets.items():
            runs[n].append((rank[n], sequence, tuple(places)))
            rank[n] += len(places) * used[pattern]
        sequence += used[pattern]
    return Plan(dict(runs), sequence)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each (length, rank)."""
    sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        runs = plan.runs[int(n)]
        run = np.searchsorted([r[0] for r in runs], rank[own], side="right") - 1
        for k in np.unique(run):
            first, start, places = runs[k]
            at = own[run == k]
            nth = rank[at] - first
            sequence[at] = start + nth // len(places)
            offset[at] = np.array(places)[nth % len(places)]
    return sequence, offset


def with_ranks(cut: DataFrame) -> DataFrame:
    """``rank`` from 0 among the pieces of one length, without bringing a length's pieces together in one task."""
    slices = parts_for(cut.count(), SLICE_ROWS, 16)
    rows = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "slice").count().select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "copy", "piece")
    return rows.withColumn("in_slice", F.row_number().over(order)).join(sums, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("in_slice") - 1)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, copy (and ids)."""
    cut = materialise(pieces(docs, vocabulary, size, end_id, with_ids))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    made = docs.sparkSession.sparkContext.broadcast(plan(histogram, size))  # by the same bound
    extra = ", ids array<long>" if with_ids else ""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, copy long" + extra
    target = arrow_schema(docs.sparkSession, schema)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(made.value, batch["length"].to_numpy(), batch["rank"].to_numpy())
            columns = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else batch[f.name].cast(f.type) for f in target], schema=target)

    return with_ranks(cut).mapInArrow(put, schema)


def packed_sequences(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """``sequence_id`` and ``ids``: the pieces of a sequence one behind the other (from ``pack(..., with_ids=True)``)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``size`` ids
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
