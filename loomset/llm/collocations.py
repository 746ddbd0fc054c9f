"""Phrase collocations per language, counted in quotient filters.

Texts are tokenised once into packs: the distinct words of some megabytes, and the order in which they come. Then, by
exchanges between packs and buckets (:mod:`loomset.llm.exchange`):

1. words: a bucket sums the counts of the words whose hash it has and answers with an id for those that are frequent
   enough. No phrase with another word can be, so a pack goes on with the stretches of frequent words alone;
2. pairs: every pack builds a counting quotient filter of its pairs of ids for each range of permuted keys
   (:mod:`loomset.llm.quotient_filter`). A range's filters from all packs are merged; the answer to a pack is one bit for
   each entry, whether that pair is frequent;
3. phrases of three to ``longest`` words whose pairs all are frequent, counted in such filters and merged the same way.

What is frequent is then a table of id sequences with counts. Every candidate is cut at all places; the counts of the
parts, which are frequent as the whole is, come from joins with that table; so do the candidates one word longer that
are as frequent (if any longer one is, one of these is too). Products are decimals of 38 digits.

Words, ids and filters follow the input through shuffles; nothing is broadcast by this module and nothing but the width
of ids and the total size goes to the driver. A word, pair or passage that is everywhere is one entry per pack.

Defined cases: a null language counts as ``und``; null and empty texts have no words; repeated rows count as often as
they come; a text of any length is taken whole; scores are whole numbers, ties go to more frequent phrases and then by
the bytes of the phrase; an empty table, or one without frequent phrases, gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm import bitpack
from loomset.llm import quotient_filter as qf
from loomset.llm.common import arrow_schema, as_text, doc_bytes, materialise, parts_for, spread
from loomset.llm.exchange import EXCHANGE, batch_rows, by_pack, exchange_batch, expand, from_planes, planes, squeeze

#: Bytes of text of a pack, and of a bucket or range.
PACK = 16 << 20
BUCKET = 24 << 20
UNDEFINED = "und"

_UPPER = bytes(range(65, 91))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"\n" * len(_ENDS) + b" ")
_NOTHING, _BREAK = 0, 1  # numbers in a pack's stream; words follow


class _Numbers(dict):
    """Words of one language to numbers, new ones as they come."""

    def __init__(self, lang: int, found: list[tuple[int, bytes]]):
        super().__init__({b"": _NOTHING, b"\n": _BREAK})
        self.lang, self.found = lang, found

    def __missing__(self, word: bytes) -> int:
        self.found.append((self.lang, word))
        self[word] = number = len(self.found) + _BREAK
        return number


class Packing:
    """Collects documents and turns them into one row."""

    def __init__(self) -> None:
        self.langs: dict[str, _Numbers] = {}
        self.found: list[tuple[int, bytes]] = []
        self.stream: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        numbers = self.langs.get(lang)
        if numbers is None:
            numbers = self.langs[lang] = _Numbers(len(self.langs), self.found)
        words = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        self.stream.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.stream.append(np.array([_BREAK]))
        self.size += len(text)

    def row(self) -> list:
        stream = np.concatenate(self.stream)
        stream = stream[stream != _NOTHING]
        stream = stream[np.append(True, (stream[1:] != _BREAK) | (stream[:-1] != _BREAK))]
        count = np.bincount(stream, minlength=len(self.found) + 2)[2:]
        lang = np.array([l for l, _ in self.found], np.int64)
        total = np.bincount(lang, count, len(self.langs)).astype(int).tolist()
        blob = squeeze(
            np.frombuffer(json.dumps(list(self.langs)).encode(), np.uint8), planes(lang, 4), np.frombuffer(b"\n".join(w for _, w in self.found), np.uint8), planes(stream, 4)
        )
        return [self.size, [{"lang": l, "n": n} for l, n in zip(self.langs, total)], blob]


PACKED = "size long, totals array<struct<lang: string, n: long>>, blob binary"


def packs(docs: DataFrame) -> DataFrame:
    """``pack, size, totals, blob``: documents of about ``PACK`` bytes together, tokenised."""
    target = arrow_schema(docs.sparkSession, PACKED)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(packing.row(), target)], schema=target)

        packing = Packing()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["data"]):
                packing.add(lang, text.as_py())
                if packing.size >= PACK:
                    yield row()
                    packing = Packing()
        if packing.langs:
            yield row()

    named = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit(UNDEFINED)).alias("lang"))
    rows = doc_bytes(spread(named), "lang").select("data", "lang")
    return materialise(rows.mapInArrow(fill, PACKED).withColumn("pack", F.monotonically_increasing_id()))


class Pack:
    def __init__(self, blob: bytes, buckets: int):
        langs, lang, words, stream = expand(blob, np.uint8, np.uint8, np.uint8, np.uint8)
        self.langs = json.loads(langs.tobytes())
        self.lang = from_planes(lang, 4).astype(np.int64)
        self.words = words.tobytes().split(b"\n") if len(self.lang) else []
        self.stream = from_planes(stream, 4).astype(np.int64)
        start = [zlib.crc32(l.encode()) for l in self.langs]
        hashed = np.fromiter((zlib.crc32(w, start[l]) for l, w in zip(self.lang.tolist(), self.words)), np.int64, len(self.words))
        bucket = hashed % buckets
        self.order = np.argsort(bucket, kind="stable")
        self.bounds = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def requests(self) -> Iterator[tuple[int, bytes]]:
        count = np.bincount(self.stream, minlength=len(self.words) + 2)[2:]
        langs = np.frombuffer(json.dumps(self.langs).encode(), np.uint8)
        for b, (first, last) in enumerate(zip(self.bounds, self.bounds[1:])):
            if first < last:
                own = self.order[first:last]
                words = np.frombuffer(b"\n".join([self.words[i] for i in own.tolist()]), np.uint8)
                yield b, squeeze(langs, planes(self.lang[own], 4), words, planes(count[own], 5))

    def runs(self, blobs: dict[int, bytes]) -> np.ndarray:
        """The stream in ids of frequent words; 0 between stretches of them."""
        ids = np.zeros(len(self.words) + 2, np.int64)
        for b, blob in blobs.items():
            ids[self.order[self.bounds[b] : self.bounds[b + 1]] + 2] = from_planes(expand(blob, np.uint8)[0], 6).astype(np.int64)
        stream = ids[self.stream]
        return stream[np.append(True, (stream[1:] > 0) | (stream[:-1] > 0))] if len(stream) else stream


def _word_requests(packed: DataFrame, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in batch_rows(batch, "pack", "blob"):
                yield exchange_batch(number, list(Pack(blob, buckets).requests()))

    return packed.select("pack", "blob").mapInArrow(send, EXCHANGE)


def _word_answers(requests: DataFrame, buckets: int, least: int) -> DataFrame:
    """To every pack the ids of its words (0: not frequent); pack -1: the bucket's frequent words with their counts."""

    def count(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        total: dict[str, dict[bytes, int]] = {}
        asked = []
        for blob in table["blob"]:
            langs, lang, words, n = expand(blob.as_py(), np.uint8, np.uint8, np.uint8, np.uint8)
            names = json.loads(langs.tobytes())
            sums = [total.setdefault(l, {}) for l in names]
            lang, words = from_planes(lang, 4).tolist(), words.tobytes().split(b"\n")
            asked.append((names, lang, words))
            for l, word, c in zip(lang, words, from_planes(n, 5).tolist()):
                own = sums[l]
                own[word] = own.get(word, 0) + c
        frequent = sorted((l, word) for l, words in total.items() for word, c in words.items() if c >= least)
        ids: dict[str, dict[bytes, int]] = {l: {} for l in total}
        for k, (l, word) in enumerate(frequent):
            ids[l][word] = k * buckets + bucket + 1
        packs, blobs = table["pack"].to_pylist(), []
        for names, lang, words in asked:
            own = [ids[l] for l in names]
            blobs.append(squeeze(planes(np.array([own[l].get(w, 0) for l, w in zip(lang, words)], np.int64), 6)))
        if frequent:
            packs.append(-1)
            names = sorted({l for l, _ in frequent})
            place = {l: k for k, l in enumerate(names)}
            blobs.append(
                squeeze(
                    np.frombuffer(json.dumps(names).encode(), np.uint8),
                    planes(np.array([place[l] for l, _ in frequent], np.int64), 4),
                    np.frombuffer(b"\n".join(w for _, w in frequent), np.uint8),
                    np.array([total[l][w] for l, w in frequent], np.int64),
                )
            )
        return pa.table([pa.array(packs, pa.int64()), pa.array([bucket] * len(packs), pa.int32()), pa.array(blobs, pa.binary())], names=["pack", "bucket", "blob"])

    return materialise(requests.groupBy("bucket").applyInArrow(count, EXCHANGE))


VOCABULARY = "id long, lang string, word string, f long"


def _vocabulary(answers: DataFrame, buckets: int) -> DataFrame:
    target = arrow_schema(answers.sparkSession, VOCABULARY)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in batch_rows(batch, "bucket", "blob"):
                langs, lang, words, f = expand(blob, np.uint8, np.uint8, np.uint8, np.int64)
                names, words = json.loads(langs.tobytes()), [as_text(w) for w in words.tobytes().split(b"\n")]
                values = [np.arange(len(f)) * buckets + bucket + 1, [names[l] for l in from_planes(lang, 4).tolist()], words, f]
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, target)], schema=target)

    return materialise(answers.where("pack = -1").select("bucket", "blob").mapInArrow(tell, VOCABULARY))


def _runs(packed: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """``pack, blob``: each pack's stream of frequent words."""
    schema = "pack long, blob binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, parts in batch_rows(batch, "pack", "blob", "parts"):
                ids = Pack(blob, buckets).runs({p["bucket"]: p["blob"] for p in parts})
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze(planes(ids, 6))], pa.binary())], names=["pack", "blob"])

    joined = packed.select("pack", "blob").join(by_pack(answers.where("pack >= 0"), "parts"), "pack")
    return materialise(joined.select("pack", "blob", "parts").mapInArrow(read, schema))


class Grams:
    """The phrases of ``n`` ids that begin at given places of a stream, as sorted distinct permuted keys."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, n: int, width: int):
        lanes = np.stack([ids[places + k] for k in range(n)]).astype(np.uint64)
        self.bits = qf.limb_bits(n, width)
        self.keys, self.counts, self.place = qf.counted(qf.to_limbs(qf.permute(lanes, width), width))

    def filters(self, range_bits: int) -> Iterator[tuple[int, bytes]]:
        edges = qf.bounds(self.keys[0], self.bits[0], range_bits)
        for r, (first, last) in enumerate(zip(edges, edges[1:])):
            if first < last:
                yield r, qf.filter_blob([k[first:last] for k in self.keys], self.counts[first:last], self.bits, range_bits)


def _stream(blob: bytes) -> np.ndarray:
    return from_planes(expand(blob, np.uint8)[0], 6).astype(np.int64)


def _pairs(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if len(ids) > 1 else np.zeros(0, np.int64)


def _pair_filters(runs: DataFrame, width: int, range_bits: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in batch_rows(batch, "pack", "blob"):
                ids = _stream(blob)
                yield exchange_batch(number, list(Grams(ids, _pairs(ids), 2, width).filters(range_bits)))

    return runs.mapInArrow(send, EXCHANGE)


def _phrase_filters(joined: DataFrame, width: int, range_bits: int, longest: int) -> DataFrame:
    """Filters of the phrases from three words on whose pairs are all frequent; ``bucket`` holds words and range."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, parts in batch_rows(batch, "pack", "blob", "parts"):
                ids = _stream(blob)
                at = _pairs(ids)
                grams = Grams(ids, at, 2, width)
                edges = qf.bounds(grams.keys[0], grams.bits[0], range_bits)
                frequent = np.zeros(len(grams.counts), bool)
                for p in parts:
                    first, last = edges[p["bucket"]], edges[p["bucket"] + 1]
                    frequent[first:last] = np.unpackbits(np.frombuffer(p["blob"], np.uint8), count=int(last - first))
                good = np.zeros(len(ids) + longest, bool)
                good[at] = frequent[grams.place]
                chain = good.copy()
                for n in range(3, longest + 1):
                    chain = chain[:-1] & good[n - 2 :][: len(chain) - 1]
                    found = Grams(ids, np.flatnonzero(chain), n, width).filters(range_bits)
                    yield exchange_batch(number, [(n << 24 | r, b) for r, b in found])

    return joined.mapInArrow(send, EXCHANGE)


FREQUENT = "ids array<long>, f long"


def _merge(filters: DataFrame, width: int, range_bits: int, least: int, answered: bool) -> DataFrame:
    """Per range the filters of all packs merged: to pack -1 - n the frequent keys of n words with their counts, and if
    ``answered`` to every pack a bit for each of its entries."""

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        n, number = (bucket >> 24) or 2, bucket & (1 << 24) - 1
        bits = qf.limb_bits(n, width)
        keys, total, places = qf.merged([qf.of_filter(b.as_py(), bits, range_bits, number) for b in table["blob"]])
        frequent = total >= least
        packs, blobs = [-1 - n], [squeeze(total[frequent], *(k[frequent] for k in keys))]
        if answered:
            packs += table["pack"].to_pylist()
            blobs += [np.packbits(frequent[p]).tobytes() for p in places]
        return pa.table([pa.array(packs, pa.int64()), pa.array([bucket] * len(packs), pa.int32()), pa.array(blobs, pa.binary())], names=["pack", "bucket", "blob"])

    return materialise(filters.groupBy("bucket").applyInArrow(merge, EXCHANGE))


def _phrases(merged: DataFrame, width: int) -> DataFrame:
    """``ids, f`` of the frequent keys, permuted back."""
    target = arrow_schema(merged.sparkSession, FREQUENT)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in batch_rows(batch, "pack", "blob"):
                n = -1 - pack
                f, *limbs = expand(blob, np.int64, *[np.uint64] * len(qf.limb_bits(n, width)))
                ids = qf.permute(qf.of_limbs(limbs, n, width), width, back=True).T.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids.tolist(), target[0].type), pa.array(f, pa.int64())], schema=target)

    return merged.where("pack < -1").select("pack", "blob").mapInArrow(tell, FREQUENT)


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of two to ``longest`` words that occur ``least`` times (ids, f); their words (id, lang, word, f); and the
    number of words per language (lang, n)."""
    packed = packs(docs)
    totals = packed.select(F.explode("totals").alias("t")).groupBy(F.col("t.lang").alias("lang")).agg(F.sum("t.n").alias("n"))
    size = packed.agg(F.sum("size")).first()[0] or 0
    buckets = parts_for(size, BUCKET, 16)
    answers = _word_answers(_word_requests(packed, buckets), buckets, least)
    vocabulary = _vocabulary(answers, buckets)
    width = bitpack.bits_for(vocabulary.agg(F.max("id")).first()[0] or 0)
    if width > qf.LIMB:
        raise ValueError(f"word ids take {width} bits, more than {qf.LIMB}")
    runs = _runs(packed, answers, buckets)
    range_bits = min(width, 24, max(4, int(buckets - 1).bit_length()))  # 24: the bucket number holds the range and the words
    pairs = _merge(_pair_filters(runs, width, range_bits), width, range_bits, least, True)
    phrases = _phrases(pairs, width)
    if longest > 2:
        joined = runs.join(by_pack(pairs.where("pack >= 0"), "parts"), "pack").select("pack", "blob", "parts")
        longer = _merge(_phrase_filters(joined, width, range_bits, longest), width, range_bits, least, False)
        phrases = phrases.union(_phrases(longer, width))
    return materialise(phrases), vocabulary, totals


def mine(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, factor: int = 1000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` best phrases of two to ``longest`` words."""
    phrases, vocabulary, totals = frequent_phrases(docs, least, longest)
    counts = phrases.union(vocabulary.select(F.array("id"), "f"))

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    parts = cuts.select(
        "ids", F.col("f").alias("a"), "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail")
    )
    parts = parts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    parts = parts.join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")

    longer = phrases.where(F.size("ids") > 2).select(
        F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), F.col("f").alias("held")
    )
    longer = longer.groupBy("ids").agg(F.max("held").alias("held"))
    words = phrases.select("ids", F.posexplode("ids").alias("place", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    named = words.groupBy("ids").agg(
        F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )

    scored = parts.join(named, "ids").join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("top", (big("a") * F.lit(factor).cast("decimal(10,0)")).cast("decimal(19,0)") * big("n"))
    scored = scored.withColumn("bottom", big("l") * big("r")).withColumn("score", F.expr("top div bottom"))
    lowest = scored.groupBy("ids").agg(F.min(F.struct("score", "k", "lang", "phrase", "a", "l", "r", "n")).alias("c"))
    kept = lowest.join(longer, "ids", "left").where(F.col("held").isNull() | (F.col("held") < F.col("c.a"))).select("c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
