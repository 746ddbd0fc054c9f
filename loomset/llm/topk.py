"""Exact top-k search by inner product: a KD-tree per shard, best-first traversal, a propagated kth score.

Vectors are cut into shards as they are read, without a shuffle. Each shard's KD-tree splits at the median of the widest
dimension, and every node keeps the tight box of its vectors. The bound of a box for a query is the largest inner
product that a point of the box can have. A search goes down the levels, drops nodes whose bound lies under the query's
kth score so far, and visits the leaves that are left best bound first until the next bound is under the kth score,
which rises with every leaf. Queries of one block that are at the same leaf share a matrix product.

The kth score is also passed on between shards: every block of queries is searched in its home shard first, and what
that gives is the bound with which it starts in all others, which then return only what reaches it. Query blocks meet
shards by a shuffle on the shard, behind the shard's tree, which travels once and is held while its blocks stream by, one
at a time. The k best of a query over all shards come from a window with a group limit, so each shard passes on at most
k rows per query.

Vectors are whole numbers floor(scale * x) of any size. Products are exact (:mod:`loomset.llm.wholevec`); where floating
point is not, box bounds are rounded up and kth scores down.

Defined cases: null vectors, vectors with null or non-finite components and rows without an id take no part, all other
vectors do, however large; an answer whose score does not fit a long ends the job with an error; a vector of any length
is searched whole; vectors are compared with those of the same length only; ties go to the smaller id; a
query gets all candidates if there are fewer than k; a row is no candidate for queries of its own id; a repeated query
row gets its own answer; repeated candidates are listed as often as they come; an empty table gives no rows; further
columns are ignored.
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
LEAF = 256


class Tree:
    """Vectors in leaf order, and per level the nodes' first rows and boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, depth: int):
        self.ids, self.vectors, self.depth = ids, vectors, depth
        self.levels = []
        for level in range(depth + 1):
            first = np.linspace(0, len(ids), (1 << level) + 1).astype(np.int64)
            if vectors.dtype == object:  # too large for float boxes
                self.levels.append((first, None, None))
                continue
            low = np.minimum.reduceat(vectors, first[:-1], axis=0)
            high = np.maximum.reduceat(vectors, first[:-1], axis=0)
            self.levels.append((first, low.astype(np.float64), high.astype(np.float64)))

    @staticmethod
    def order(vectors: np.ndarray) -> tuple[np.ndarray, int]:
        """The rows in leaf order, and the depth of the tree."""
        n = len(vectors)
        depth = 0 if vectors.dtype == object else max(0, int(np.log2(max(1, n / LEAF))))
        order = np.arange(n)
        for level in range(depth):
            first = np.linspace(0, n, (1 << level) + 1).astype(np.int64)
            cut = np.linspace(0, n, (2 << level) + 1).astype(np.int64)[1::2]
            for start, middle, end in zip(first, cut, first[1:]):
                own = order[start:end]
                part = vectors[own]
                wide = int(np.argmax(part.max(0).astype(float) - part.min(0))) if part.shape[1] else 0
                value = part[:, wide] if part.shape[1] else np.zeros(len(own))
                order[start:end] = own[np.argpartition(value, middle - start)]
        return order, depth

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
        order, depth = Tree.order(vectors)
        return Tree(ids[order], vectors[order], depth)

    @staticmethod
    def of(blob: bytes, depth: int, scale: float) -> Tree:
        ids, _, vectors = wholevec.of_blob(blob, scale)
        return Tree(ids, vectors, depth)


def _bounds(queries: np.ndarray, low: np.ndarray | None, high: np.ndarray | None) -> np.ndarray:
    """The largest product that a point of each box can have with each query, rounded up where it is not exact."""
    if low is None or queries.dtype == object:
        return np.full((len(queries), 1), np.inf)
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    bound = up @ high.T + down @ low.T
    size = up @ np.abs(high).T - down @ np.abs(low).T
    return bound + size * ((queries.shape[1] + 4) * 2.0**-51) if size.max(initial=0) >= 1 << 52 else bound


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate id, score) of each query's at most k best with at least the score ``floor``; other ids only."""
    kth = floor.astype(np.float64)
    found = (np.zeros(0, np.int64),) * 3
    alive = np.ones((len(ids), 1), bool)
    for level, (first, low, high) in enumerate(tree.levels):
        bound = _bounds(queries, low, high)
        alive = (np.repeat(alive, 2, axis=1) if level else alive) & (bound >= kth[:, None])
    bound = np.where(alive, bound, -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    products = wholevec.Products(queries, tree.vectors)
    for turn in range(order.shape[1]):
        leaf = order[:, turn]
        at = bound[np.arange(len(ids)), leaf]
        active = np.flatnonzero((at >= kth) & (at > -np.inf))
        if not len(active):
            break
        gained = []
        for node in np.unique(leaf[active]):
            rows = active[leaf[active] == node]
            q, c, score = products.at_least(rows, int(first[node]), int(first[node + 1]), kth[rows])
            other = ids[rows[q]] != tree.ids[c]
            gained.append((rows[q[other]], tree.ids[c[other]], score[other]))
        found = wholevec.best(*(np.concatenate([found[i], *(g[i] for g in gained)]) for i in range(3)), k)
        wholevec.raise_kth(kth, found[0], found[2], k)
    return found


def shards(vectors: DataFrame, vec_id: str, embedding: str, modulus: int, scale: float) -> DataFrame:
    """``shard, width, depth, tree, queries``: at most ``SHARD`` vectors of one length in the order of their KD-tree, and
    the queries among them."""
    schema = "width int, depth int, tree binary, queries binary"
    target = arrow_schema(vectors.sparkSession, schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (width, _), ids, _, x in wholevec.gathered(batches, scale, SHARD):
            order, depth = Tree.order(wholevec.whole(x, scale))
            ids, x, none = ids[order], x[order], np.zeros(0, np.int64)
            own = ids % modulus == 0
            values = [[width], [depth], [wholevec.to_blob(ids, none, x, scale)], [wholevec.to_blob(ids[own], none, x[own], scale)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target)], schema=target)

    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    return materialise(rows.mapInArrow(build, schema).withColumn("shard", F.monotonically_increasing_id()))


FOUND = "block long, number int, query_id long, vec_id long, score long"


def _search_rows(rows: DataFrame, k: int, scale: float) -> DataFrame:
    """Each row's block of queries in the tree of its row, or of the last row before it that has one; ``floors``, if there,
    has a starting score per query."""
    target = arrow_schema(rows.sparkSession, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for block, depth, blob, asked, floors in batch_rows(batch, "block", "depth", "tree", "queries", "floors"):
                if blob is not None:
                    tree = Tree.of(blob, depth, scale)
                if asked is None:
                    continue
                ids, _, queries = wholevec.of_blob(asked, scale)
                if not len(ids):
                    continue
                floor = np.full(len(ids), -np.inf)
                for f in floors or []:
                    floor[f["number"]] = wholevec.below(f["floor"])
                query, number, score = search(tree, ids, queries, k, floor)
                values = [np.full(len(query), block), query, ids[query], number, wholevec.as_longs(score)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target)], schema=target)

    return rows.select("block", "depth", "tree", "queries", "floors").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, k: int, modulus: int, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id ``modulus`` divides, its k best other rows."""
    built = shards(vectors, vec_id, embedding, modulus, scale)
    floors = F.lit(None).cast("array<struct<number: int, floor: long>>").alias("floors")
    home = materialise(_search_rows(built.select("*", F.col("shard").alias("block"), floors), k, scale))
    full = home.groupBy("block", "number").agg(F.min("score").alias("floor"), F.count("score").alias("n")).where(F.col("n") >= k)
    full = full.groupBy("block").agg(F.collect_list(F.struct("number", "floor")).alias("floors"))  # at most SHARD entries
    blocks = built.select(F.col("shard").alias("block"), "width", "queries").join(full, "block", "left")
    # every block goes to every other shard of its length: the stated query set against all rows, block by block
    in_width = Window.partitionBy("width").orderBy("shard")
    places = built.select("shard", "width").withColumn("place", F.row_number().over(in_width) - 1).drop("width")  # a number per shard
    sent = blocks.join(built.groupBy("width").agg(F.count("*").cast("int").alias("shards")), "width")
    sent = sent.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    sent = sent.join(places.withColumnRenamed("shard", "block"), "block").where(sent["place"] != places["place"]).drop(places["place"])
    none = F.lit(None)
    trees = built.select("shard", "width", "depth", "tree").join(places, "shard")
    trees = trees.select("width", "place", F.lit(-1).cast("long").alias("block"), "depth", "tree", none.cast("binary").alias("queries"), floors)
    asked = sent.select("width", "place", "block", none.cast("int").alias("depth"), none.cast("binary").alias("tree"), "queries", "floors")
    met = trees.union(asked).repartition("width", "place").sortWithinPartitions("width", "place", "block")
    away = _search_rows(met, k, scale)
    order = Window.partitionBy("block", "number").orderBy(F.desc_nulls_last("score"), "vec_id")
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.coalesce(F.col("score"), F.raise_error(F.lit("an inner product does not fit a 64-bit integer")).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
