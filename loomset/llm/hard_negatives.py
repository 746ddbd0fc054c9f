"""Hard-negative mining by slot-decomposed selection over exact inner products.

An anchor's positives are its best rows of the same label. Every positive has a window of scores in which rows of other
labels are its hard negatives; the windows of one anchor overlap. Their upper limits, in descending order, cut the
scores into disjoint slots: slot j holds what lies above limit j + 1 and not above limit j. The best negatives of
window j are then the best of slots j, j + 1, ... in this order, cut at the window's lower limit. So it is enough to keep
the best ``negatives`` rows of every slot, whatever the windows:

1. anchors meet all rows, block by block, once for the positives and once, with the limits known, for the slots; a
   combiner per task holds the best of every anchor (or anchor and slot) over a group of shards and drops what lies under
   the kth score that it has;
2. the combiners' results meet in a window with a group limit per anchor (and slot);
3. each anchor's slots, ordered, are one descending list; the suffix that begins at slot j answers window j.

Rows are cut into shards as they are read. Anchors of several shards form a block of bounded size. A task gets a block,
then streams the shards of one group past it: blocks go to groups, and shards to blocks, by one shuffle, so nothing is
broadcast, a task holds one block and one shard, and what it returns does not grow with the number of shards in a group.
The stated set of anchors is compared with all rows; there is no other product.

Defined cases: rows without an id or label, with a null vector or with null or non-finite components take no part;
vectors of any size of components are exact (:mod:`loomset.llm.wholevec`), a positive's score that does not fit a long
ends the job with an error; vectors are compared with those of the same length only; rows of the anchor's own id are no
positives or negatives of it; a repeated anchor row gets its own answer and repeated rows count as often as they come;
ties go to the smaller id; a positive with a negative score has no window (its lower limit lies above the upper); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm import wholevec
from loomset.llm.common import arrow_schema, materialise, ship
from loomset.llm.exchange import batch_rows

SHARD = 8192
#: Anchors together, and shards that one task streams past them.
BLOCK, GROUP = 4096, 32
#: Pairs whose scores a task holds at a time.
TILE = 1 << 22

ANCHORED = "width int, block long, number int, anchor_id long"


def shards(vectors: DataFrame, modulus: int, scale: float) -> DataFrame:
    """``shard, width, blob, anchors, n``: rows of one length together, and the anchors among them."""
    schema = "width int, blob binary, anchors binary, n long"
    target = arrow_schema(vectors.sparkSession, schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (width, _), ids, labels, x in wholevec.gathered(batches, scale, SHARD):
            own = ids % modulus == 0
            blobs = [wholevec.to_blob(ids[at], labels[at], x[at], scale) for at in (slice(None), own)]
            values = [[width], [blobs[0]], [blobs[1]], [int(own.sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target)], schema=target)

    ship(vectors.sparkSession)
    built = vectors.select("id", "label", "vector").mapInArrow(build, schema)
    return materialise(built.withColumn("shard", F.monotonically_increasing_id()))


class Block:
    """Anchors of one block: ids, labels and vectors in the order of their numbers."""

    def __init__(self, blobs: list[bytes], scale: float):
        parts = [wholevec.of_blob(blob, scale) for blob in blobs]
        self.ids, self.labels = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        kinds = {p[2].dtype == object for p in parts}
        self.vectors = np.concatenate([p[2].astype(object) if len(kinds) > 1 else p[2] for p in parts])


class Positives:
    """The best rows of the same label for each anchor of a block."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.kth = np.full(len(block.ids), -np.inf)
        self.found = (np.zeros(0, np.int64),) * 3

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        products = wholevec.Products(self.block.vectors, vectors)
        for label in np.unique(self.block.labels):
            first, last = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
            own = np.flatnonzero(self.block.labels == label)
            for rows, start, end in _tiles(own, int(first), int(last)):
                q, c, score = products.at_least(rows, start, end, self.kth[rows])
                other = self.block.ids[rows[q]] != ids[c]
                gained = rows[q[other]], ids[c[other]], score[other]
                self.found = wholevec.best(*(np.concatenate(x) for x in zip(self.found, gained)), self.k)
                wholevec.raise_kth(self.kth, self.found[0], self.found[2], self.k)

    def rows(self) -> list:
        number, ids, score = self.found
        return [number, self.block.ids[number], ids, wholevec.as_longs(score)]


class Slots:
    """The best rows of other labels for each slot of each anchor of a block."""

    def __init__(self, block: Block, limits: list[dict], width: int, k: int):
        self.block, self.width, self.k = block, width, k
        n = len(block.ids)
        self.high, self.low = np.full((n, width), -np.inf), np.full((n, width), np.inf)
        for x in limits or []:
            self.high[x["number"], x["slot"]], self.low[x["number"], x["slot"]] = x["high"], x["low"]
        # limits are whole numbers below 2 ** 63; as floats they are exact where products are
        self.limits = {(x["number"], x["slot"]): (x["low"], x["high"]) for x in limits or []}
        self.kth = np.full(n * width, -np.inf)
        self.found = (np.zeros(0, np.int64),) * 3

    def need(self) -> np.ndarray:
        """Per anchor the least score that any slot can still use."""
        return np.maximum(self.low, self.kth.reshape(self.low.shape)).min(axis=1)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        products = wholevec.Products(self.block.vectors, vectors)
        own = np.flatnonzero(np.isfinite(self.high[:, 0]))
        top = self.high[:, 0]
        for rows, start, end in _tiles(own, 0, len(ids)):
            q, c, score = products.at_least(rows, start, end, self.need()[rows], top[rows])
            other = self.block.labels[rows[q]] != labels[c]
            q, c, score = rows[q[other]], c[other], score[other]
            other = self.block.ids[q] != ids[c]
            q, c, score = q[other], c[other], score[other]
            key, score, c = self._slots(q, score, c)
            self.found = wholevec.best(*(np.concatenate(x) for x in zip(self.found, (key, ids[c], score))), self.k)
            wholevec.raise_kth(self.kth, self.found[0], self.found[2], self.k)

    def _slots(self, q: np.ndarray, score: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if score.dtype == object or (len(score) and int(np.abs(score).max()) >= 1 << 53):
            place = np.full(len(q), -1, np.int64)
            for i, (row, s) in enumerate(zip(q.tolist(), score.tolist())):
                inside = [j for j in range(self.width) if (row, j) in self.limits and s <= self.limits[row, j][1]]
                if inside and s >= self.limits[row, inside[-1]][0]:
                    place[i] = inside[-1]
            keep = place >= 0
            return q[keep] * self.width + place[keep], score[keep], c[keep]
        place = (self.high[q] >= score[:, None]).sum(axis=1) - 1
        key = q * self.width + place
        keep = (place >= 0) & (score >= self.low.ravel()[key]) & (score >= self.kth[key])
        return key[keep], score[keep], c[keep]

    def rows(self) -> list:
        key, ids, score = self.found
        number = key // self.width
        return [number, self.block.ids[number], key % self.width, ids, wholevec.as_longs(score)]


def _tiles(rows: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Parts of the product rows x [first, last), small ones first, so that kth scores are soon known."""
    size = 256
    while first < last and len(rows):
        end = min(last, first + size)
        step = max(1, TILE // (end - first))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], first, end
        first, size = end, size * 4


def _meet(built: DataFrame, blocks: DataFrame, schema: str, scale: float, combiner) -> DataFrame:
    """What ``combiner(block, limits)`` has per block and group of shards after it has met all of them."""
    target = arrow_schema(built.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def told() -> pa.RecordBatch:
            columns = state.rows()
            head = [np.full(len(columns[0]), at[0]), np.full(len(columns[0]), at[1])]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([*head, *columns], target)], schema=target)

        for batch in batches:
            for width, block, group, blob, anchors, limits in batch_rows(batch, "width", "block", "grp", "blob", "anchors", "limits"):
                if anchors is not None:
                    if state is not None:
                        yield told()
                    at, state = (width, block, group), combiner(Block(anchors, scale), limits)
                else:
                    state.meet(*wholevec.of_blob(blob, scale))
        if state is not None:
            yield told()

    places = built.select("shard", "width").withColumn("place", F.row_number().over(Window.partitionBy("width").orderBy("shard")) - 1)
    placed = built.select("shard", "blob").join(places, "shard").withColumn("grp", F.floor(F.col("place") / GROUP).cast("int"))
    n_groups = places.groupBy("width").agg((F.floor(F.max("place") / GROUP).cast("int")).alias("last"))
    to_groups = blocks.join(n_groups, "width").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("last"))))
    to_groups = to_groups.select("width", "block", "grp", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("blob"), "anchors", "limits")
    numbers = blocks.select("width", "block")
    to_blocks = placed.join(numbers.groupBy("width").agg(F.collect_list("block").alias("blocks")), "width")  # one number per BLOCK anchors
    to_blocks = to_blocks.withColumn("block", F.explode("blocks"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in blocks.dtypes if name in ("anchors", "limits")]
    rows = to_groups.union(to_blocks.select("width", "block", "grp", "place", "blob", *none))
    keys = ["width", "block", "grp"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "place").drop("place").mapInArrow(run, schema)


def mine(
    vectors: DataFrame,
    modulus: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id ``modulus`` divides. Of each positive's window, from ``low`` to ``high`` percent of its
    score, the best ``negatives`` rows of other labels are returned.
    """
    named = [F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vector")]
    built = shards(vectors.select(*named), modulus, scale)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("width").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = built.where("n > 0").select("shard", "width", "n").withColumn("block", F.floor(before / BLOCK)).select("shard", "block")
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("shard", "anchors"))), lambda x: x["anchors"])  # at most BLOCK + SHARD anchors
    blocks = materialise(built.select("shard", "width", "anchors").join(numbered, "shard").groupBy("width", "block").agg(gathered.alias("anchors")))

    limits_type = "array<struct<number: int, slot: int, low: long, high: long>>"
    schema = f"{ANCHORED}, vec_id long, score long"
    first = _meet(built, blocks.withColumn("limits", F.lit(None).cast(limits_type)), schema, scale, lambda block, _: Positives(block, positives))
    order = Window.partitionBy("width", "block", "number").orderBy(F.desc_nulls_last("score"), "vec_id")
    chosen = first.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives)
    wide = F.col("score").cast("decimal(19,0)")
    chosen = chosen.where("score >= 0").withColumns(
        {"low": F.ceil(wide * low / 100).cast("long"), "high": F.floor(wide * high / 100).cast("long")}
    )
    chosen = materialise(chosen.withColumnRenamed("vec_id", "positive_id").withColumnRenamed("score", "positive_score"))

    limits = chosen.groupBy("width", "block").agg(F.collect_list(F.struct("number", "slot", "low", "high")).alias("limits"))
    schema = f"{ANCHORED}, slot int, vec_id long, score long"
    second = _meet(built, blocks.join(limits, ["width", "block"]), schema, scale, lambda block, known: Slots(block, known, positives, negatives))
    order = Window.partitionBy("width", "block", "number", "slot").orderBy(F.desc("score"), "vec_id")
    kept = second.withColumn("k", F.row_number().over(order)).where(F.col("k") <= negatives)
    down = F.struct("slot", (-F.col("score")).alias("minus"), "vec_id", "score")
    slots = kept.groupBy("width", "block", "number").agg(F.array_sort(F.collect_list(down)).alias("slots"))  # at most slots x negatives
    met = chosen.join(slots, ["width", "block", "number"])
    suffix = F.slice(F.filter("slots", lambda x: x["slot"] >= F.col("slot")), 1, negatives)
    own = F.filter(suffix, lambda x: x["score"] >= F.col("low"))
    told = met.select("anchor_id", "positive_id", "positive_score", F.posexplode(own).alias("rank", "found"))
    return told.select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("found.vec_id").alias("negative_id"),
        "positive_score", F.col("found.score").alias("negative_score"),
    )
