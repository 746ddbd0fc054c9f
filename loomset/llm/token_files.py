"""Token ids in binary files of fixed-width bit packing.

A set of files holds the ids of all documents in ascending order of ``doc_id``. Every id takes as many bits as the
largest id of the vocabulary needs. A file is made of

- a head: magic, bits per id, ids per block;
- blocks of ``BLOCK`` ids each (the last has fewer), packed by :mod:`loomset.llm.bitpack`;
- tables: the byte offset and the CRC-32 of every block, the id of every document and how many ids stand before it;
- a tail of fixed size that says how many documents, ids and blocks there are and where the tables begin.

So a reader opens a file at its tail, knows from the tables which blocks hold the ids it wants, reads these alone and
unpacks them with NumPy (:class:`TokenFile`). Documents are never cut between files.

Writing: texts are dealt out by ranges of ``doc_id`` and sorted within them, so each task streams one stretch of the
order into files of about ``FILE_IDS`` ids, holding one block and the tables. File names are new in every attempt; the
manifest, a table written by Spark when all tasks are done, names those that count, so retried and speculative tasks
leave nothing that a reader sees. Rows of the manifest are as many as files; a running sum over it gives every file's
first id. Reading: one task for each file of the manifest.

The ids are those of the tokenizers library. The vocabulary's pattern never joins white space to a token, so a text is
cut at spaces and line feeds, and ids are put together from a bounded cache of chunks. A new chunk of printable
characters up to U+00FF is cut by the same pattern here, and the library's model encodes its parts, as whole calls cost
several times more; any other chunk, and any that might hold a special token, is encoded by a whole call.

Defined cases: a null or empty text is its end id alone; rows of one id stand together, ordered by the hash of their
texts, and are written as often as they come; rows without an id come first; a text of any length is one document; an
empty table gives a manifest without rows; further columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.llm import bitpack
from loomset.llm.bytelevel import byte_symbols
from loomset.llm.common import arrow_schema, as_text, doc_bytes, ship
from loomset.llm.exchange import batch_rows

BLOCK = 1 << 15
FILE_IDS = 1 << 25
#: Ids that a reader unpacks at a time.
READ_IDS = 1 << 20
#: Chunks, and pretokens, that a worker remembers, and the longest that it does.
CACHED, CACHED_CHARS = 1 << 19, 64
#: Characters of a text that are cut into chunks at a time.
PART = 1 << 20

_MAGIC = b"LMTOKENS"
_HEAD = struct.Struct("<8sII")
_TAIL = struct.Struct("<QQQQI8s")
MANIFEST = "part int, place int, file string, docs long, ids long, bits int"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _file_system(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path))


#: Characters whose class, lower case and bytes need no Unicode tables: printable ones up to U+00FF.
_NARROW = re.compile("[!-~¡-¬®-ÿ]+")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class _Pretokens(dict):
    """Ids of pretokens of narrow characters in lower case, by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        symbols = byte_symbols()
        self.table = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(0xA1, 0x100)}

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word if word.isascii() else word.translate(self.table))
        out = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(word) <= CACHED_CHARS:
            self[word] = out
        return out


class _Chunks(dict):
    """Ids of what stands between two spaces."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.pretokens = tokenizer, _Pretokens(tokenizer.model)

    def __missing__(self, chunk: str) -> bytes:
        if _NARROW.fullmatch(chunk) and "<|" not in chunk:
            out = b"".join(map(self.pretokens.__getitem__, _PRETOKENS.findall(chunk.lower())))
        else:
            out = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= CACHED_CHARS:
            self[chunk] = out
        return out


class Coder:
    """The ids that the tokenizers library gives with one of its files, chunk by chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks = _Chunks(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._part, _parts(text)))

    def _part(self, text: str) -> bytes:
        for held in (self.chunks, self.chunks.pretokens):
            if len(held) > CACHED:
                held.clear()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def _parts(text: str) -> Iterator[str]:
    """The text cut at spaces into parts of about ``PART`` characters."""
    at = 0
    while len(text) - at > PART:
        end = text.find(" ", at + PART)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


class Writer:
    """One file, written front to back."""

    def __init__(self, folder: str, name: str, bits: int, block: int):
        self.fs, top = _file_system(folder)
        self.name, self.bits, self.block = name, bits, block
        self.out = self.fs.open_output_stream(f"{top}/{name}")
        self.out.write(_HEAD.pack(_MAGIC, bits, block))
        self.offsets, self.sums = [_HEAD.size], []
        self.held, self.waiting = [], 0
        self.doc_ids, self.nulls, self.starts = [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._blocks(self.waiting // self.block * self.block)

    def _blocks(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for at in range(0, upto, self.block):
            data = bitpack.pack(ids[at : min(at + self.block, upto)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
            self.sums.append(zlib.crc32(data))
        self.held, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> tuple[str, int, int]:
        """The file's name, its documents and its ids."""
        if self.waiting:
            self._blocks(self.waiting)
        tables = b"".join(
            np.array(values, kind).tobytes()
            for values, kind in ((self.offsets, "<u8"), (self.sums, "<u4"), (self.doc_ids, "<i8"), (self.nulls, "<u1"), (self.starts, "<u8"))
        )
        self.out.write(tables)
        self.out.write(_TAIL.pack(len(self.doc_ids), self.starts[-1], len(self.sums), self.offsets[-1], zlib.crc32(tables), _MAGIC))
        self.out.close()
        return self.name, len(self.doc_ids), self.starts[-1]


class TokenFile:
    """A file opened for reading: ``doc_ids``, ``starts`` and any stretch of its ids."""

    def __init__(self, path: str):
        fs, inner = _file_system(path)
        self.path, self.source = path, fs.open_input_file(inner)
        size = self.source.size()
        if size < _HEAD.size + _TAIL.size:
            raise ValueError(f"{path} is no token file")
        magic, self.bits, self.block = _HEAD.unpack(self.source.read_at(_HEAD.size, 0))
        docs, self.n_ids, blocks, tables, checked, end = _TAIL.unpack(self.source.read_at(_TAIL.size, size - _TAIL.size))
        data = b""
        if magic == _MAGIC == end and _HEAD.size <= tables <= size - _TAIL.size:
            data = self.source.read_at(size - _TAIL.size - tables, tables)
        if not data or zlib.crc32(data) != checked:
            raise ValueError(f"{path} is no token file or is damaged")
        at = 0

        def taken(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.offsets, self.sums = taken("<u8", blocks + 1).astype(np.int64), taken("<u4", blocks)
        numbers, nulls = taken("<i8", docs), taken("<u1", docs)
        self.doc_ids = [None if n else i for i, n in zip(numbers.tolist(), nulls.tolist())]
        self.starts = taken("<u8", docs + 1).astype(np.int64)

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` (places in the file) as uint32; only their blocks are read."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = memoryview(self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first])))
        out = []
        for b in range(first, last + 1):
            part = data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]]
            if zlib.crc32(part) != self.sums[b]:
                raise ValueError(f"block {b} of {self.path} is damaged")
            out.append(bitpack.unpack(part, min(self.block, self.n_ids - b * self.block), self.bits).astype("<u4"))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1]))

    def documents(self, at_once: int = READ_IDS) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, its first place in the file, ids) in the order of the file."""
        first = 0
        while first < len(self.doc_ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + at_once, side="right")) - 1)
            base = int(self.starts[first])
            found = self.ids(base, int(self.starts[last]))
            for k in range(first, last):
                a, b = int(self.starts[k]), int(self.starts[k + 1])
                yield self.doc_ids[k], a, found[a - base : b - base]
            first = last


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Encode ``docs`` into token files under ``folder``; its manifest, which is also written there."""
    spark = docs.sparkSession
    ship(spark)
    schema = MANIFEST
    target = arrow_schema(spark, schema)
    block, file_ids = BLOCK, FILE_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = coder(vocabulary)
        bits = bitpack.bits_for(max(end_id, coding.tokenizer.get_vocab_size(with_added_tokens=True) - 1))
        part, place = TaskContext.get().partitionId(), 0
        writer = None
        end = np.array([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            values = [part, place, *writer.close(), bits]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

        for batch in batches:
            for doc_id, data in zip(batch["doc_id"].to_pylist(), batch["data"]):
                if writer is None:
                    writer = Writer(folder, f"ids-{part:06d}-{place:04d}-{uuid.uuid4().hex}.bin", bits, block)
                writer.add(doc_id, np.frombuffer(coding.encode(as_text(data.as_py())) + end, "<u4"))
                if writer.starts[-1] >= file_ids:
                    yield closed()
                    writer, place = None, place + 1
        if writer is not None:
            yield closed()

    _make_folder(folder)
    rows = doc_bytes(docs.select("doc_id", "text")).withColumn("mark", F.xxhash64("data"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # equal rows, however many, go to more than one task
    order = [F.asc_nulls_first("doc_id"), "mark", "row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "data")
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def _make_folder(folder: str) -> None:
    fs, inner = _file_system(folder)
    fs.create_dir(inner, recursive=True)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that count, with the place of each one's first id among all: ``file, start, docs, ids, bits``."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("ids").over(Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1))
    named = F.concat(F.lit(f"{folder}/"), F.col("file"))
    return rows.select(named.alias("file"), F.coalesce(before, F.lit(0)).cast("long").alias("start"), "docs", "ids", "bits")


def _read(files: DataFrame, schema: str, columns) -> DataFrame:
    spark = files.sparkSession
    ship(spark)
    target = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in batch_rows(batch, "file", "start"):
                with TokenFile(file) as opened:
                    held = []
                    size = 0
                    for doc_id, at, ids in opened.documents():
                        held.append(columns(doc_id, start + at, ids))
                        size += len(ids)
                        if size >= READ_IDS or len(held) >= 8192:
                            yield _batch(held, target)
                            held, size = [], 0
                    if held:
                        yield _batch(held, target)

    count = max(1, files.count())
    return files.select("file", "start").repartition(count).mapInArrow(run, schema)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), target)], schema=target)


def documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files of a manifest."""
    return _read(files, "doc_id long, start long, ids array<long>", lambda i, at, ids: (i, at, ids.tolist()))


def digests(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a manifest."""
    return _read(files, RESULT, lambda i, at, ids: (i, at, len(ids), zlib.crc32(ids.tobytes())))
