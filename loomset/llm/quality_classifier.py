"""Quality classifier: zstandard dictionaries of good and of bad text; compressed sizes become a calibrated score.

Two dictionaries are trained, one from good and one from bad labelled texts. A text is cut into blocks of ``BLOCK``
bytes and each block is compressed with either dictionary, so the dictionaries weigh as much at a long text's end as at
its start. From the two total sizes come the normalised difference (bad - good) / (bad + good) and the rates good / bytes and
bad / bytes; a logistic regression on them and on squares and product of difference and rate, fitted on other labelled
texts, turns them into the probability of label 1.

Fitting uses a bounded sample: of each label at most ``sample`` texts (those with the smallest hash of doc_id). One half
trains the dictionaries, with at most ``EXCERPT`` bytes of each text, in blocks drawn by a hash from all over the text;
the other half, whole and on the executors, gives the features for the calibration, weighted back to the share of the
labels in the whole training set. Every document is scored whole, without a shuffle.

Defined cases: a null or empty text scores the share of label 1 in the training rows; without texts of both labels every
score is that share (0.5 if there are no labels at all); null labels and null doc_ids are not learned from; a document
with several labels counts once per distinct label; repeated rows are scored alike; an empty table gives no rows; labels,
language, source and doc_id are no input of a score; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomset.llm.common import doc_bytes, is_held_out, map_rows, ship, spread

SAMPLE = 4096
EXCERPT = 8192
BLOCK = 2048
DICTIONARY = 65536
LEVEL = 3
#: Constant part of the ridge, which holds the calibration back where few texts are labelled, and the bound of its features
#: in standard deviations, so that no text is judged by extrapolation.
FEW, FAR = 5.0, 4.0


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    share: float  # of label 1 in the training rows


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d is not None:
        d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def sizes(data: bytes, good: bytes, bad: bytes) -> tuple[int, int]:
    g, b = _compressor(good).compress, _compressor(bad).compress
    in_good = in_bad = 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        in_good += len(g(block))
        in_bad += len(b(block))
    return in_good, in_bad


def _features(data: bytes, good: bytes, bad: bytes) -> list[float]:
    g, b = sizes(data, good, bad)
    difference, rate = (b - g) / (b + g), min(2.0, g / len(data))
    return [difference, rate, min(2.0, b / len(data)), difference * difference, difference * rate, rate * rate]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, quality, data, half`` of at most ``sample`` texts of each label (half 0: dictionaries, 1: calibration), and
    the number of training labels of each; no held-out rows."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .where(~is_held_out(3, 1))
        .distinct()
    )
    count = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = rows.where("quality = 1").orderBy(*order).limit(sample).union(rows.where("quality = 0").orderBy(*order).limit(sample))
    place = F.row_number().over(Window.partitionBy("quality").orderBy(*order))  # at most ``sample`` rows of each
    some = some.withColumn("half", ((place + 1) % 2).cast("int"))
    found = doc_bytes(docs).where(F.length("data") > 0).join(F.broadcast(some), "doc_id")
    return found.dropDuplicates(["doc_id", "quality", "data"]), count


def _excerpt(data: Column, key: Column) -> Column:
    """The whole text if it has at most ``EXCERPT`` bytes, else that many in blocks of ``BLOCK``, taken from all of its
    blocks by a hash and put in the text's order."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(data) - 1) / BLOCK).cast("int"))
    drawn = F.slice(F.array_sort(F.transform(blocks, lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i")))), 1, EXCERPT // BLOCK)
    parts = F.transform(F.array_sort(F.transform(drawn, lambda x: x["i"])), lambda i: F.substring(data, i * BLOCK + 1, F.lit(BLOCK)))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda s, p: F.concat(s, p))
    return F.when(F.length(data) <= EXCERPT, data).otherwise(joined)


def _calibration(sampled: DataFrame, good: bytes, bad: bytes) -> list[tuple[int, list[float]]]:
    """Label and features of the sampled whole texts, worked out where they are; a few numbers per text."""
    def step(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [_features(d, good, bad) for d in batch["data"]]}

    found = map_rows(sampled.where("half = 1").select("doc_id", "quality", "data"), "doc_id long, quality int, x array<double>", step)
    return [(r["quality"], r["x"]) for r in found.orderBy("doc_id", "quality", "x").collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    sampled, count = labelled_sample(docs.select("doc_id", "text"), labels, sample)
    total = sum(count.values())
    share = count.get(1, 0) / total if total else 0.5
    excerpts = sampled.where("half = 0").select("quality", "doc_id", _excerpt(F.col("data"), F.col("doc_id")).alias("data"))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for q, _, d in sorted(excerpts.collect(), key=lambda r: (r[0], r[1], r[2])):
        texts[q].append(bytes(d))
    if not all(texts.values()):
        return Model(b"", b"", (), (), (), share)
    shared = {line for t in texts[0] for line in t.split(b"\n")} & {line for t in texts[1] for line in t.split(b"\n")}
    good, bad = (_dictionary([_without(t, shared) for t in texts[q]]) for q in (1, 0))
    known = _calibration(sampled, good, bad)
    y, x = np.array([float(q) for q, _ in known]), np.array([f for _, f in known])
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", (), (), (), share)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, tuple(_logistic(np.clip((x - mean) / scale, -FAR, FAR), y, weight)), tuple(mean), tuple(scale), share)


def _without(text: bytes, shared: set[bytes]) -> bytes:
    """The text without lines that texts of both labels hold: they say nothing about quality."""
    return b"\n".join(line for line in text.split(b"\n") if line not in shared)


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, blocks)) // 8)), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples to train on: the texts themselves are the dictionary
        return b"".join(blocks)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge * len(x) + FEW] * (x.shape[1] - 1) + [1e-9])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def probability(data: bytes, model: Model) -> float:
    if not data or not model.weights:
        return model.share
    z = model.weights[-1]
    for f, m, s, w in zip(_features(data, model.good, model.bad), model.mean, model.scale, model.weights):
        z += w * max(-FAR, min(FAR, (f - m) / s))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes

    def step(batch: dict[str, list]) -> dict[str, list]:
        scores = [probability(d, shared.value) for d in batch["data"]]
        return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    rows = doc_bytes(spread(docs.select("doc_id", "text")), is_held_out(3, 1).alias("held_out"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", step)


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spare = "".join(docs.columns) + "_score"  # clashes with no column
    schema = StructType([*docs.schema.fields, StructField(spare, DoubleType())])

    def step(batches):
        for batch in batches:
            scores = [probability(t or b"", shared.value) for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, spare])

    return spread(docs).mapInArrow(step, schema).where(F.col(f"`{spare}`") >= threshold).drop(spare)
