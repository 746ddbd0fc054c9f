"""Quality rules: hashed n-gram log-likelihood ratio between a trusted-target and the raw-corpus multinomial.

Every document's words, its word pairs and the shapes of its words are hashed into ``BUCKETS`` counters, once over all
documents (raw) and once over all documents that the trusted set names (target). With add-one smoothing that makes two
multinomials. A document's verdict is the mean over its n-grams of log(p_target / p_raw); it is kept from ``threshold``
on. The counters are the only thing gathered: ``2 * BUCKETS`` numbers, whatever the size of the corpus; each task adds
up its own before they are summed by bucket, so no common word meets in one task.

A word's shape keeps its other characters and turns runs of small or non-ASCII letters into ``a``, of capitals into
``A`` and of digits into ``0``: rare and made-up words then still say how they are written.

Beside the verdict stand plain rules on the whole text (``base_failed``): too few words, or more than half of the words
inside three-word windows that recur in the text.

Defined cases: a null or empty text has no words and fails; repeated rows are counted and judged as often as they come;
a null doc_id keeps its row and is never trusted; an empty table gives no rows; if no document is trusted, the ratio is
0 for all and only the plain rules decide; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import arrow_schema, as_text, doc_bytes, map_rows, spread
from loomset.llm.wordhash import groups, pair_hash, words

BUCKETS = 1 << 16
THRESHOLD = -0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"



def features(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Group by group: the number of the text, and the bucket, of every word, word pair and word shape."""
    last: tuple[int, int] | None = None  # the word before, where a long text goes on in the next group
    for numbers, pieces in groups(texts):
        piece, word, shape = words(pieces, shapes=True)
        text = np.asarray(numbers)[piece]
        if not len(text):
            continue
        before, before_text = word[:-1], text[:-1]
        if last is not None and last[0] == text[0]:
            before, before_text = np.concatenate([[np.uint64(last[1])], before]), np.concatenate([[last[0]], before_text])
        after = len(word) - len(before)
        same = before_text == text[after:]
        pair = pair_hash(before[same], word[after:][same])
        last = (int(text[-1]), int(word[-1]))
        found = np.concatenate([word, pair, shape]) % np.uint64(buckets)
        yield np.concatenate([text, before_text[same], text]), found.astype(np.int64)


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target``: counts over all documents and over those whose doc_id is in ``trusted`` (column doc_id).

    All ids are used. Ids and texts meet in one shuffle whatever their number, so nothing that grows is broadcast.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    rows = doc_bytes(docs).join(ids.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
    schema = "bucket int, raw long, target long"
    out = arrow_schema(docs.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.array(batch["target"].to_pylist(), dtype=object) == True  # noqa: E712  null: not trusted
            for text, found in features(batch["data"].to_pylist(), buckets):
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[good[text]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], schema=out)

    partial = rows.mapInArrow(count, schema)
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) per bucket, add-one smoothed; at most ``buckets`` rows come to the driver."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets, np.float32)
    return (np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))).astype(np.float32)


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total, end = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def repeated_lines(text: bytes) -> int:
    """Lines (cut at newlines) with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [line for line in lines if line.split(None, 1)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept."""
    docs = spread(docs.select("doc_id", "text"))
    weights = log_ratio(ngram_counts(docs, trusted, buckets), buckets)
    packed = docs.sparkSession.sparkContext.broadcast(weights.tobytes())  # 4 * buckets bytes
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"

    def step(batch: dict[str, list]) -> dict[str, list]:
        weight = np.frombuffer(packed.value, np.float32)
        total, times = np.zeros(len(batch["data"])), np.zeros(len(batch["data"]))
        for text, found in features(batch["data"], buckets):
            total += np.bincount(text, weight[found], minlength=len(total))
            times += np.bincount(text, minlength=len(total))
        rows = []
        for doc_id, data, ratio in zip(batch["doc_id"], batch["data"], (total / np.maximum(times, 1)).tolist()):
            words, text = data.split(), as_text(data)
            n = len(words)
            repeated = repeated_window_words(words)
            failed = n < MIN_WORDS or 100 * repeated > 50 * n
            chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
            rows.append((doc_id, n, chars, sum(map(text.count, SYMBOLS)), repeated_lines(data), repeated, failed, ratio, not failed and ratio >= threshold))
        return dict(zip((f.split()[0] for f in schema.split(", ")), map(list, zip(*rows))))

    return map_rows(doc_bytes(docs), schema, step)
