"""Suffix-array dedup: difference-cover blockwise construction.

A byte goes if a run of ``length`` bytes (50) around it also starts in a document with a smaller doc_id. So what counts
is the order of all suffixes as far as their first ``length`` bytes, and the smallest doc_id among those that agree so
far. The suffix array is built block by block and no block is ever the whole corpus:

1. Texts are put into packs of a few megabytes (whole documents, compressed), written to the shared folder.
2. Every ``length``-byte window has an anchor, the leftmost of its ``GRAM``-byte strings with the smallest hash. Equal
   windows have equal anchors at the same place in them, so an anchor's hash says which suffix bucket a window is in.
   A first exchange of anchor hashes leaves out anchors that occur in one document only: their windows have no partner.
3. What is left goes to its bucket as snippets (the anchor with the bytes that its windows reach over), equal ones of a
   pack once. A bucket is sorted block by block. Suffixes are compared by their bytes up to the next column of a
   difference cover modulo ``PERIOD``, fewer than ``PERIOD`` of them, and longer ties by the ranks of the cover's sample
   suffixes, worked out beforehand from right to left. So no comparison reads long ties again, and memory is that of one
   block. Windows of an anchor with over ``HOT`` snippets go one by one to a bucket by the hash of the whole window, which
   equal windows share. Neighbours in a block's suffix array that agree in ``length`` bytes form a class; its smallest doc_id decides.
4. Verdicts, one bit per window, go back to the packs, where the covered bytes are taken out.

Exchanged rows are packs times buckets, of bytes in proportion to the input. A passage that a third of all documents
share is one snippet per pack, so its class has at most as many entries as there are packs in any task, apart from the
list of ids. Anchors only choose the bucket; no window is skipped.

Defined cases: a null or empty text, or one shorter than ``length``, loses nothing; matches never cross documents; rows
with the same doc_id do not remove each other's bytes; a null doc_id counts as larger than all others; an empty table
gives no rows; repeated rows of one doc_id stay as they are; further columns are ignored by :func:`dedup` and carried
along by :func:`strip_repeats`, which also drops what is left of a UTF-8 character that a cut divides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomset.llm.common import arrow_schema, doc_bytes, materialise, parts_for, spread
from loomset.llm.exchange import EXCHANGE, batch_rows, by_pack, exchange_batch, expand, squeeze
from loomset.llm.wordhash import mix

LENGTH = 50
GRAM = 16
PACK = 4 << 20
#: Bytes of text behind one suffix bucket, and rows sorted as one block of it.
BUCKET = 24 << 20
BLOCK_ROWS = 1 << 16
#: Distinct snippets of one anchor (added up over packs) beyond which its windows are dealt out one by one.
HOT = 1 << 16
#: A difference cover: every difference modulo PERIOD is one of two of these numbers (Colbourn and Ling's size for 16 is 5).
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
SLICE = 1 << 19
NO_ID = np.iinfo(np.int64).max


# --- packs and anchors -----------------------------------------------------------------------------------------------


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``data`` ends with eight spare bytes or more."""
    out = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        part = data[k : k + (len(data) - k) // 8 * 8].view("<u8")
        out[k::8] = part[: len(out[k::8])]
    return out


def gram_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(low * np.uint64(0x9E3779B97F4A7C15) ^ mix(high))


def anchors(data: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, over the concatenated texts: (windows in the run, anchor minus first window)."""
    reach = length - GRAM + 1  # anchors possible in a window
    counts, shifts = [], []
    ends = np.cumsum(lengths)
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    for at in range(0, max(1, len(data)), SLICE):  # windows that start here
        stop = min(len(data), at + SLICE)
        part = padded[at : min(len(padded), stop + reach + 2 * GRAM)]
        word = _words_at(part)
        value = gram_hash(word[:-8], word[8:])[: stop - at + reach - 1]
        missing = stop - at + reach - 1 - len(value)  # behind the data, where no window ends: never the smallest
        value = np.concatenate([value, np.full(max(0, missing), np.iinfo(np.uint64).max)])
        best, place, span = value, np.arange(len(value), dtype=np.int32), 1
        while span < reach:
            step = min(span, reach - span)
            first = best[: len(best) - step] <= best[step:]
            best, place = np.where(first, best[: len(first)], best[step:]), np.where(first, place[: len(first)], place[step:])
            span += step
        start = np.arange(at, stop)
        text = np.searchsorted(ends, start, side="right")
        valid = np.flatnonzero(start + length <= ends[np.minimum(text, len(ends) - 1)])
        if not len(valid):
            continue
        anchor, text = place[valid], text[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        counts.append(np.diff(np.append(first, len(valid))))
        shifts.append(anchor[first] - valid[first])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(counts).astype(np.uint8), join(shifts).astype(np.uint8)


def packs(rows: DataFrame, length: int) -> DataFrame:
    """``pack, size, blob, rest``: whole documents (``doc_id``, ``data``, ``rest``) of about ``PACK`` bytes together, with
    their anchor runs and what is carried along."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        rests: list[pa.Array] = []
        held = 0

        def row() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(texts), np.uint8)
            lengths = np.array([len(t) for t in texts], np.int64)
            null = np.array([i is None for i in ids], np.uint8)
            number = np.array([NO_ID if i is None else i for i in ids], np.int64)
            blob = squeeze(number, null, lengths, data, *anchors(data, lengths, length))
            rest = _store(pa.concat_arrays(rests)) if rests else None
            values = [pa.array([len(data)], pa.int64()), pa.array([blob], pa.binary()), pa.array([rest], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["size", "blob", "rest"])

        for batch in batches:
            carried = batch["rest"] if "rest" in batch.schema.names else None
            from_row = 0
            for at, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["data"])):
                ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= PACK:
                    if carried is not None:
                        rests.append(carried.slice(from_row, at + 1 - from_row))
                    from_row = at + 1
                    yield row()
                    ids, texts, rests, held = [], [], [], 0
            if carried is not None and from_row < batch.num_rows:
                rests.append(carried.slice(from_row))
        if ids:
            yield row()

    return materialise(rows.mapInArrow(fill, "size long, blob binary, rest binary").withColumn("pack", F.monotonically_increasing_id()))


def _store(rows: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([rows], names=["rest"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _restore(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all()["rest"].combine_chunks()


class Pack:
    """A pack unfolded: its texts, its anchor runs in order, and what follows from them alike in every step."""

    def __init__(self, blob: bytes, length: int):
        self.ids, null, self.lengths, self.data, counts, shifts = expand(blob, np.int64, np.uint8, np.int64, np.uint8, np.uint8, np.uint8)
        self.null = null.astype(bool)
        self.length = length
        self.counts, self.shifts = counts.astype(np.int64), shifts.astype(np.int64)
        windows = np.maximum(self.lengths - length + 1, 0)
        ends = np.cumsum(self.lengths)
        before = (ends - self.lengths) - (np.cumsum(windows) - windows)  # place of a text's first window minus its number
        number = np.cumsum(self.counts) - self.counts
        self.text = np.searchsorted(np.cumsum(windows), number, side="right")
        self.start = number + before[self.text] if len(number) else number
        self.anchor = self.start + self.shifts

    def keys(self) -> np.ndarray:
        """The anchor's hash of each run."""
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        place = self.anchor[:, None] + np.arange(GRAM)
        parts = [padded[place[at : at + 65536]].view("<u8") for at in range(0, len(place), 65536)]
        both = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
        return gram_hash(both[:, 0], both[:, 1])


def window_hash(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on."""
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(start), 65536):
        place = start[at : at + 65536]
        part = np.zeros((len(place), -(-length // 8) * 8), np.uint8)
        part[:, :length] = data[place[:, None] + np.arange(length)]
        value = np.zeros(len(place), np.uint64)
        for word in part.view("<u8").T:
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) ^ mix(word))
        out[at : at + 65536] = value
    return out


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _key_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by (bucket, key), the place of each key among them, and the bounds of the buckets."""
    found, inverse = np.unique(keys, return_inverse=True)
    order = np.argsort(_bucket_of(found, buckets), kind="stable")
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    bounds = np.searchsorted(_bucket_of(found, buckets)[order], np.arange(buckets + 1))
    return found[order], place[inverse], bounds


def _anchor_keys(packed: DataFrame, buckets: int, length: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in batch_rows(batch, "pack", "blob"):
                pack = Pack(blob, length)
                found, place, bounds = _key_order(pack.keys(), buckets)
                low = np.full(len(found), len(pack.ids))
                high = np.full(len(found), -1)
                np.minimum.at(low, place, pack.text)
                np.maximum.at(high, place, pack.text)
                several = low < high
                times = np.bincount(place, minlength=len(found))
                more = np.flatnonzero(times[place] > 1)
                rows = _snippet_rows(pack, pack.anchor[more], pack.shifts[more], pack.counts[more])
                _, one = np.unique(rows, return_index=True)  # equal snippets have one anchor
                times[place[more]] = 0
                np.add.at(times, place[more[one]], 1)
                times = np.minimum(times, 65535).astype(np.uint16)
                blobs = []
                for b in range(buckets):
                    own = found[bounds[b] : bounds[b + 1]]
                    if len(own):
                        five = own.view(np.uint8).reshape(-1, 8)[:, :5]
                        blobs.append((b, squeeze(five, np.packbits(several[bounds[b] : bounds[b + 1]]), times[bounds[b] : bounds[b + 1]])))
                yield exchange_batch(number, blobs)

    return packed.select("pack", "blob").mapInArrow(send, EXCHANGE)


def _repeated(keys: DataFrame) -> DataFrame:
    """Per pack and bucket: two bits for each of its distinct keys, set if the key is in several texts, and if it has over
    ``HOT`` snippets."""

    def judge(table: pa.Table) -> pa.Table:
        parts, flags, counted = [], [], []
        for blob in table["blob"]:
            five, bits, times = expand(blob.as_py(), np.uint8, np.uint8, np.uint16)
            counted.append(times)
            wide = np.zeros((len(five) // 5, 8), np.uint8)
            wide[:, :5] = five.reshape(-1, 5)
            parts.append(wide.view("<u8").ravel())
            flags.append(np.unpackbits(bits, count=len(wide)).astype(bool))
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = np.zeros(len(every), bool)
        same[1:] |= ranked[1:] == ranked[:-1]
        same[:-1] |= ranked[1:] == ranked[:-1]
        repeated = np.concatenate(flags)
        repeated[order] |= same
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        total = np.add.reduceat(np.concatenate(counted).astype(np.int64)[order], first)
        hot = np.zeros(len(every), bool)
        hot[order] = np.repeat(total > HOT, np.diff(np.append(first, len(every))))
        out, at = [], 0
        for part in parts:
            out.append(squeeze(np.packbits(repeated[at : at + len(part)]), np.packbits(hot[at : at + len(part)])))
            at += len(part)
        return pa.table([table["pack"], table["bucket"], pa.array(out, pa.binary())], names=["pack", "bucket", "blob"])

    return keys.groupBy("bucket").applyInArrow(judge, EXCHANGE)


# --- snippets and their blocks ---------------------------------------------------------------------------------------


def _snippet_rows(pack: Pack, anchor: np.ndarray, shift: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The snippet of each run as one value: its bytes, the column of its first window, the number of its windows."""
    left, width = pack.length - GRAM, 2 * pack.length - GRAM
    padded = np.concatenate([np.zeros(left, np.uint8), pack.data, np.zeros(width, np.uint8)])
    column = np.arange(width)
    first = left - shift
    snippet = padded[anchor[:, None] + column]
    inside = (column >= first[:, None]) & (column < (first + count + pack.length - 1)[:, None])
    snippet = np.where(inside, snippet, np.uint8(0))
    full = np.concatenate([snippet, first[:, None].astype(np.uint8), count[:, None].astype(np.uint8)], axis=1)
    return np.ascontiguousarray(full).view(f"V{width + 2}").ravel()


def _units(pack: Pack, bits: dict[int, bytes], buckets: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per bucket: runs whose anchor is repeated, as distinct (snippet, doc_id) units.

    The windows of a hot anchor are runs by themselves, in one of ``buckets`` further buckets by the hash of the window.
    Gives (the runs' first windows and window counts, the unit of each run, the snippets' bytes, first columns and window
    counts, the snippet of each unit, the doc_id of each unit). It depends on the pack and the bits alone, so both steps
    that call it agree.
    """
    width = 2 * pack.length - GRAM
    keys = pack.keys()
    found, place, bounds = _key_order(keys, buckets)
    repeated, hot = np.zeros(len(found), bool), np.zeros(len(found), bool)
    for b, blob in bits.items():
        n = bounds[b + 1] - bounds[b]
        for flags, packed in zip((repeated, hot), expand(blob, np.uint8, np.uint8)):
            flags[bounds[b] : bounds[b + 1]] = np.unpackbits(packed, count=n).astype(bool)
    cold = np.flatnonzero(repeated[place] & ~hot[place])
    wide = np.flatnonzero(repeated[place] & hot[place])
    each = pack.counts[wide]
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    wide = np.repeat(wide, each)
    runs = np.concatenate([cold, wide])
    start = np.concatenate([pack.start[cold], pack.start[wide] + step])
    count = np.concatenate([pack.counts[cold], np.ones(len(wide), np.int64)])
    number = window_hash(pack.data, start[len(cold) :], pack.length) % np.uint64(buckets)
    bucket = np.concatenate([_bucket_of(keys[cold], buckets), buckets + number.astype(np.int64)])
    order = np.argsort(bucket, kind="stable")
    runs, start, count, bucket = runs[order], start[order], count[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(2 * buckets + 1))
    out = {}
    for b in range(2 * buckets):
        some = slice(cuts[b], cuts[b + 1])
        own = runs[some]
        if not len(own):
            continue
        rows = _snippet_rows(pack, pack.anchor[own], pack.anchor[own] - start[some], count[some])
        distinct, which = np.unique(rows, return_inverse=True)
        distinct = distinct.view(np.uint8).reshape(len(distinct), width + 2)
        ids = pack.ids[pack.text[own]]
        by = np.lexsort((ids, which))
        new = np.ones(len(by), bool)
        new[1:] = (which[by][1:] != which[by][:-1]) | (ids[by][1:] != ids[by][:-1])
        unit = np.empty(len(own), np.int64)
        unit[by] = np.cumsum(new) - 1
        out[b] = (start[some], count[some], unit, distinct, which[by][new].astype(np.uint32), ids[by][new])
    return out


def _snippets(joined: DataFrame, buckets: int, length: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, bits in batch_rows(batch, "pack", "blob", "parts"):
                units = _units(Pack(blob, length), {p["bucket"]: p["blob"] for p in bits or []}, buckets)
                blobs = [(b, squeeze(distinct, which, ids)) for b, (*_, distinct, which, ids) in units.items()]
                if blobs:
                    yield exchange_batch(number, blobs)

    return joined.mapInArrow(send, EXCHANGE)


class Block:
    """The suffix array of one block: rows of snippets, padded, in which windows start at columns."""

    def __init__(self, rows: np.ndarray, length: int):
        self.length = length
        self.width = rows.shape[1]
        self.rows = np.concatenate([rows, np.zeros((len(rows), 16), np.uint8)], axis=1)
        cover = [c for c in range(self.width) if c % PERIOD in COVER]
        rank = np.zeros(len(rows), np.int64)  # behind the last column all suffixes are empty
        self.rank, after = {}, self.width
        for c in reversed(cover):
            head = self._head(c, after - c)
            order = np.lexsort((rank, head))
            new = np.zeros(len(order), np.int64)
            new[1:] = (head[order][1:] != head[order][:-1]) | (rank[order][1:] != rank[order][:-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new)
            self.rank[c], after = rank, c
        self.next = {c: min((k for k in cover if k >= c), default=self.width) for c in range(self.width)}

    def _head(self, column: int, n: int) -> np.ndarray:
        """The ``n`` (at most eight) bytes from a column on as a number that sorts like them."""
        word = np.ascontiguousarray(self.rows[:, column : column + 8]).view(">u8").ravel().astype(np.uint64)
        return word >> np.uint64(64 - 8 * n) if n else np.zeros(len(word), np.uint64)

    def classes(self, column: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the rows ``some`` from a column on, in suffix order, and the first of each class of equal ones."""
        after = self.next[column]
        rank = self.rank[after][some] if after in self.rank else np.zeros(len(some), np.int64)
        order = some[np.lexsort((rank, self._head(column, after - column)[some]))]
        window = self.rows[order, column : column + self.length]
        new = np.ones(len(order), bool)
        new[1:] = (window[1:] != window[:-1]).any(axis=1)
        return order, np.flatnonzero(new)


def window_verdicts(snippets: np.ndarray, which: np.ndarray, ids: np.ndarray, length: int, single: bool = False) -> np.ndarray:
    """For each unit (snippet ``which``, doc id): a bit per window, set if the window is in a document with a smaller id.

    Snippets that are ``single`` windows need not be in a block with others of their anchor, only with equal ones.

    ``snippets`` has a row per snippet: its bytes, the column of its first window, the number of its windows.
    """
    width = snippets.shape[1] - 2
    distinct, row = np.unique(np.ascontiguousarray(snippets).view(f"V{width + 2}").ravel(), return_inverse=True)
    distinct = distinct.view(np.uint8).reshape(len(distinct), width + 2)
    row = row[which]
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, row, ids)
    text, first, count = distinct[:, :width], distinct[:, width].astype(np.int64), distinct[:, width + 1].astype(np.int64)
    anchor = np.ascontiguousarray(text[:, length - GRAM : length]).view("<u8").reshape(-1, 2)
    key = gram_hash(anchor[:, 0], anchor[:, 1])
    if single:
        key = window_hash(text.ravel(), np.arange(len(text)) * width + first, length)
    out = np.zeros(len(ids), np.uint64)
    order = np.argsort(key, kind="stable")
    unit_order = np.argsort(row, kind="stable")
    unit_bounds = np.searchsorted(row[unit_order], np.arange(len(distinct) + 1))
    at = 0
    while at < len(order):  # blocks of whole anchors, or of whole windows
        end = min(len(order), at + BLOCK_ROWS)
        while end < len(order) and key[order[end]] == key[order[end - 1]]:
            end += 1
        rows = order[at:end]
        at = end
        block = Block(text[rows], length)
        own_first, own_count, own_least = first[rows], count[rows], least[rows]
        units = np.concatenate([unit_order[unit_bounds[r] : unit_bounds[r + 1]] for r in rows])
        local = np.repeat(np.arange(len(rows)), unit_bounds[rows + 1] - unit_bounds[rows])
        for column in range(length - GRAM + 1):
            some = np.flatnonzero((own_first <= column) & (column < own_first + own_count))
            if not len(some):
                continue
            ranked, heads = block.classes(column, some)
            smallest = np.full(len(rows), NO_ID)
            smallest[ranked] = np.repeat(np.minimum.reduceat(own_least[ranked], heads), np.diff(np.append(heads, len(ranked))))
            hit = smallest[local] < ids[units]
            shift = np.maximum(column - own_first[local[hit]], 0).astype(np.uint64)
            out[units[hit]] |= np.uint64(1) << shift
    return out


def _verdicts(snippets: DataFrame, buckets: int, length: int) -> DataFrame:
    """Per pack and bucket: the window bits of its units."""

    def judge(table: pa.Table) -> pa.Table:
        rows, which, ids, sizes, at = [], [], [], [], 0
        for blob in table["blob"]:
            r, w, i = expand(blob.as_py(), np.uint8, np.uint32, np.int64)
            r = r.reshape(-1, 2 * length - GRAM + 2)
            rows.append(r)
            which.append(w.astype(np.int64) + at)
            ids.append(i)
            sizes.append(len(i))
            at += len(r)
        bits = window_verdicts(np.concatenate(rows), np.concatenate(which), np.concatenate(ids), length, table["bucket"][0].as_py() >= buckets)
        blobs = [squeeze(part) for part in np.split(bits, np.cumsum(sizes)[:-1])]
        return pa.table([table["pack"], table["bucket"], pa.array(blobs, pa.binary())], names=["pack", "bucket", "blob"])

    return snippets.groupBy("bucket").applyInArrow(judge, EXCHANGE)


# --- the whole -------------------------------------------------------------------------------------------------------


def removed_spans(pack: Pack, bits: dict[int, bytes], verdicts: dict[int, bytes], buckets: int) -> np.ndarray:
    """True for each byte of the pack that is to go."""
    change = np.zeros(len(pack.data) + 1, np.int32)
    for b, (start, count, unit, *_) in _units(pack, bits, buckets).items():
        mask = expand(verdicts[b], np.uint64)[0][unit]
        for k in range(int(count.max())):
            hit = start[(mask >> np.uint64(k) & np.uint64(1)).astype(bool)] + k
            change[hit] += 1  # a window starts at most once
            change[hit + pack.length] -= 1
    return np.cumsum(change[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _run(rows: DataFrame, length: int) -> tuple[DataFrame, int]:
    """Packs with the verdicts on their windows (columns blob, rest, parts, verdicts), and the number of buckets."""
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 63}")
    packed = packs(rows, length)
    buckets = parts_for(packed.agg(F.sum("size")).first()[0] or 0, BUCKET, 24)
    parts = materialise(by_pack(_repeated(_anchor_keys(packed, buckets, length)), "parts"))
    # both uses of this join read the same columns and run in one plan, so packs are shuffled once and read twice
    sent = packed.select("pack", "blob", *(c for c in ["rest"] if c in rows.columns)).join(parts, "pack", "left")
    verdicts = by_pack(_verdicts(_snippets(sent, buckets, length), buckets, length), "verdicts")
    return sent.join(verdicts, "pack", "left"), buckets


def _documents(blob: bytes, parts, verdicts, buckets: int, length: int) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """(doc_id, bytes, which of them go) of a pack's documents, in order."""
    pack = Pack(blob, length)
    gone = removed_spans(pack, {p["bucket"]: p["blob"] for p in parts or []}, {v["bucket"]: v["blob"] for v in verdicts or []}, buckets)
    end = 0
    for doc_id, null, n in zip(pack.ids.tolist(), pack.null.tolist(), pack.lengths.tolist()):
        yield None if null else doc_id, pack.data[end : end + n], gone[end : end + n]
        end += n


def dedup(docs: DataFrame, length: int = LENGTH, with_spans: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_spans`` also ``spans`` (start and end of
    each removed run, in bytes) and ``kept`` (the remaining bytes)."""
    found, buckets = _run(doc_bytes(spread(docs.select("doc_id", "text"))), length)
    schema = RESULT + (", spans array<struct<start: long, end: long>>, kept binary" if with_spans else "")
    target = arrow_schema(docs.sparkSession, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, parts, verdicts in batch_rows(batch, "blob", "parts", "verdicts"):
                out: list[tuple] = []
                for doc_id, text, away in _documents(blob, parts, verdicts, buckets, length):
                    edge = np.flatnonzero(np.diff(away, prepend=False, append=False)) if away.any() else np.zeros(0, np.int64)
                    kept = (text[~away] if len(edge) else text).tobytes()
                    row = (doc_id, len(text), len(text) - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest())
                    out.append(row + (([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()], kept) if with_spans else ()))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), target)], schema=target)

    return found.select("blob", "parts", "verdicts").mapInArrow(cut, schema)


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs``, with what is repeated from documents with smaller ids taken out of ``text``."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found, buckets = _run(doc_bytes(spread(docs), rest.alias("rest")), length)
    schema = StructType([StructField("rest", StructType([f for f in docs.schema.fields if f.name != "text"])), StructField("text", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, carried, parts, verdicts in batch_rows(batch, "blob", "rest", "parts", "verdicts"):
                texts = [t[~away].tobytes().decode("utf-8", "ignore") for _, t, away in _documents(blob, parts, verdicts, buckets, length)]
                yield pa.RecordBatch.from_arrays([_restore(carried), pa.array(texts, pa.string())], names=["rest", "text"])

    out = found.select("blob", "rest", "parts", "verdicts").mapInArrow(cut, schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))
