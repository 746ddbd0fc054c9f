"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits; bit i is set if it is set in more than half of the XXH64 hashes of its word
shingles. Fingerprints link at ``distance`` or fewer differing bits. Each differing bit spoils at most one of the eight
bytes, so linked fingerprints share at least 8 - distance bytes at their places: the guaranteed minimum of matches.

One list per byte place and value would hold a 256th of all fingerprints, too many to pair. Lists are therefore kept for
combinations of places. If 8 - distance of 8 places match, then among the first ``8 - (8 - distance) + width`` places at
least ``width`` do, so the combinations of ``width`` of those places find every pair; ``width`` follows from the number
of fingerprints, so that a list of unrelated ones stays short. Within a list the shared bytes of each pair are tallied,
pairs under the minimum go, the rest is verified bit by bit, and links that join what is not joined yet are passed on.
A list of more than ``LIST`` members is not paired but indexed again by more places: first by all combinations of
8 - distance bytes, then by combinations of three-bit blocks of the other bytes, where a list cannot hold more than
2 ** (3 * distance) different fingerprints. No link is lost and no list is cut.

Exact copies are one entry: all lists, links and components are of distinct fingerprints.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer
words than a shingle are one shingle; a null doc_id is kept, its component is the smallest other id of its group, or
null; repeated rows are in one component; an empty table gives no rows; columns that are in no use are carried along
by :func:`keep_first` and ignored otherwise.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import doc_bytes, map_rows, materialise, spread
from loomset.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
LIST = 1024


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's shingles, ASCII letters lowered; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), ">u8", len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and the integer columns ``more``."""
    source = doc_bytes(spread(docs.select("doc_id", "text")), *more)
    extra = [f for f in source.schema if f.name not in ("doc_id", "data")]

    def step(batch: dict[str, list]) -> dict[str, list]:
        found = np.array([fingerprint(d, shingle) for d in batch["data"]], np.uint64).view(np.int64).tolist()
        return {"doc_id": batch["doc_id"], "fp": found} | {f.name: batch[f.name] for f in extra}

    return map_rows(source, ", ".join(["doc_id long", "fp long", *(f"{f.name} long" for f in extra)]), step)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def byte_masks(places: int, width: int) -> list[int]:
    """The masks that keep ``width`` of the first ``places`` bytes."""
    return [_signed(sum(0xFF << 8 * p for p in chosen)) for chosen in itertools.combinations(range(places), width)]


def _block_masks(kept: int, distance: int) -> list[int]:
    """A byte mask refined: the bits it leaves out are cut into blocks of three, of which all but ``distance`` are kept too."""
    left = [bit for bit in range(64) if not kept >> bit & 1]
    blocks = [left[i : i + 3] for i in range(0, len(left), 3)]
    return [_signed(kept | sum(1 << b for block in chosen for b in block)) for chosen in itertools.combinations(blocks, len(blocks) - distance)]


def _width(count: int, minimum: int) -> int:
    """Places per combination so that unrelated fingerprints fill a list with about one member or less."""
    return next((w for w in range(min(3, minimum), minimum) if count <= 1 << 8 * w), minimum)


def _lists(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (mask, fp): the lists of at most ``LIST`` members as arrays, and the rows of longer lists."""
    keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    counts = materialise(keyed.groupBy("mask", "key").count().where("count > 1"))
    short = keyed.join(counts.where(F.col("count") <= LIST).drop("count"), ["mask", "key"])
    long = keyed.join(counts.where(F.col("count") > LIST).drop("count"), ["mask", "key"]).select("mask", "fp")
    return short.groupBy("mask", "key").agg(F.collect_list("fp").alias("members")).select("members"), long


def _pairs(lists: DataFrame, minimum: int, distance: int) -> DataFrame:
    """Tally shared bytes in every list, keep pairs with at least ``minimum``, verify; one link less than each group has members."""

    def step(batch: dict[str, list]) -> dict[str, list]:
        a: list[int] = []
        b: list[int] = []
        two = np.array([m for m in batch["members"] if len(m) == 2], np.int64).reshape(-1, 2)
        linked = _linked(two[:, 0].copy(), two[:, 1].copy(), minimum, distance)
        a += two[linked, 0].tolist()
        b += two[linked, 1].tolist()
        for members in batch["members"]:
            if len(members) > 2:
                for x, y in _spanning(np.array(members, np.int64), minimum, distance):
                    a.append(x)
                    b.append(y)
        return {"a": a, "b": b}

    return map_rows(lists, "a long, b long", step)


def _linked(x: np.ndarray, y: np.ndarray, minimum: int, distance: int) -> np.ndarray:
    differ = np.bitwise_xor(x, y)
    shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(-1)
    return (shared >= minimum) & (np.bitwise_count(differ.view(np.uint64)) <= distance)


def _spanning(members: np.ndarray, minimum: int, distance: int) -> list[tuple[int, int]]:
    """Links that join the members as far as linked pairs do, by breadth-first search."""
    left = np.ones(len(members), bool)
    out = []
    for start in range(len(members)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[_linked(members[rest], np.full(len(rest), members[at]), minimum, distance)]
            left[near] = False
            front += near.tolist()
            out += [(int(members[at]), int(members[n])) for n in near]
    return out


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that join exactly what links of at most ``distance`` bits join."""
    minimum = 8 - distance
    if minimum < 1:
        raise ValueError("distance must be below 8: with more spoiled bytes no match is guaranteed")
    spark = distinct.sparkSession
    width = _width(distinct.count(), minimum)
    explode = lambda df, masks: df.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    short, long = _lists(explode(distinct, byte_masks(8 - minimum + width, width)))
    found = [_pairs(short, minimum, distance)]
    long = materialise(long.select("fp").distinct())
    if not long.isEmpty():
        short, long = _lists(explode(long, byte_masks(8, minimum)))
        found.append(_pairs(short, minimum, distance))
        long = materialise(long)
        if not long.isEmpty():
            finer = {m: _block_masks(m & (1 << 64) - 1, distance) for m in byte_masks(8, minimum)}
            table = spark.createDataFrame([(m, b) for m, blocks in finer.items() for b in blocks], "mask long, finer long")
            rows = long.join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask")).distinct()
            keyed = rows.groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
            lists = keyed.agg(F.collect_list("fp").alias("members"))  # at most 2 ** (3 * distance) members
            found.append(_pairs(lists.where(F.size("members") > 1).select("members"), minimum, distance))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def grouped(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with ``component_id``, the smallest doc_id reachable over links."""
    least = F.min("doc_id")
    # a class is named by its smallest id, so the root of a component is the id to report; ids may be null or repeated
    name = F.struct(F.isnull(least).alias("unknown"), F.coalesce(least, F.lit(0)).alias("least"), F.first("fp").alias("fp"))
    classes = materialise(rows.groupBy("fp").agg(name.alias("name")))
    found = links(classes.select("fp"), distance)
    for end in ("a", "b"):
        found = found.join(classes.select(F.col("fp").alias(end), F.col("name").alias(f"{end}_name")), end)
    roots = components(found.select(F.col("a_name").alias("a"), F.col("b_name").alias("b")))
    roots = roots.select(F.col("node.fp").alias("fp"), "root")
    root = F.coalesce("root", "name")
    component = F.when(~root["unknown"], root["least"]).alias("component_id")
    # written first: a join of two plain tables is one whose large keys Spark splits, and exact copies share a fingerprint
    labelled = materialise(classes.join(roots, "fp", "left").select("fp", component))
    return rows.join(labelled, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = grouped(materialise(fingerprints(docs, shingle)), distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of ``docs``."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    taken = {c.lower() for c in docs.columns}
    key, own = (next(n for i in itertools.count() if (n := f"{stem}{i}") not in taken) for stem in ("row_hash", "row_id"))
    rows = materialise(fingerprints(docs, shingle, text_hash.alias("text_hash")))
    first = grouped(rows, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("fp").agg(F.min("doc_id").alias(own), F.min("text_hash").alias(key)).drop("fp")
    marked = docs.withColumn(key, text_hash)
    same = marked["doc_id"].cast("long").eqNullSafe(first[own]) & (marked[key] == first[key])
    return marked.join(first, same).drop(first[key]).dropDuplicates([own, key]).select(*docs.columns)
