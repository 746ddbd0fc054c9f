"""The language model's scores against deleted interpolation written out token by token."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomset.llm import language_model
from loomset.llm.queries import is_held_out

END, START = "</end>", "<start>"


def _tokens(text):
    lowered = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    for ch in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(ch, " ")
    return [w for w in lowered.split(" ") if w] + [END]


def _magnitude(count):
    return min(count.bit_length(), language_model.MAGNITUDES - 1)


def _plain(rows):
    """doc_id -> log10 probability; weights by expectation-maximisation on every training token, left out of all counts."""
    texts = {doc_id: _tokens(text) for doc_id, text in rows}
    train = [doc_id for doc_id in texts if zlib.crc32(str(doc_id).encode()) % 7 != 2]
    one, two, before = Counter(), Counter(), Counter()
    for doc_id in train:
        for h, w in zip([START, *texts[doc_id]], texts[doc_id]):
            one[w] += 1
            two[h, w] += 1
            before[h] += 1
    before = Counter({START: before[START]}) + Counter({w: n for w, n in one.items()})
    n, slots = sum(one.values()), len(one) + 1
    bucket, estimates = [], []
    for doc_id in train:
        for h, w in zip([START, *texts[doc_id]], texts[doc_id]):
            context = before[h] - 1
            bucket.append(_magnitude(context))
            estimates.append(((two[h, w] - 1) / context if context else 0.0, (one[w] - 1) / (n - 1), 1 / slots))
    bucket, estimates = np.array(bucket), np.array(estimates)
    weights = np.full((language_model.MAGNITUDES, 3), 1 / 3)
    for _ in range(language_model.ROUNDS):
        joint = weights[bucket] * estimates
        share = joint / joint.sum(1, keepdims=True)
        for b in set(bucket.tolist()):
            weights[b] = share[bucket == b].mean(0)
    seen = set(bucket.tolist())
    for b in range(language_model.MAGNITUDES):
        if b not in seen:
            weights[b] = weights[max(k for k in seen if k < b)] if any(k < b for k in seen) else weights[min(seen)]
    weights[0, 1], weights[0, 0] = weights[0, 1] + weights[0, 0], 0
    scores = {}
    for doc_id, words in texts.items():
        total = 0.0
        for h, w in zip([START, *words], words):
            l2, l1, l0 = weights[_magnitude(before[h])]
            total += math.log10(l2 * (two[h, w] / before[h] if before[h] else 0) + l1 * one[w] / n + l0 / slots)
        scores[doc_id] = total
    return scores


def _rows():
    """Texts of words with unequal frequencies and habitual followers, and some unknown words."""
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, "only once"), (3, "Tie TIE tie"), (4, "tie tie\ttie")]
    for doc_id in range(5, 240):
        words, at = [], 0
        for _ in range(int(rng.integers(1, 160))):
            at = (at * 7 + 1) % 90 if rng.random() < 0.6 else int(90 * rng.random() ** 3)
            words.append(f"W{at}" if rng.random() < 0.97 else f"rare{rng.integers(10**6)}")
        rows.append((doc_id, " ".join(words)))
    return rows


@pytest.mark.parametrize("pack", [language_model.PACK, 4_000])
def test_scores_are_those_of_deleted_interpolation(spark, monkeypatch, pack):
    monkeypatch.setattr(language_model, "PACK", pack)
    rows = _rows()
    want = _plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(docs, is_held_out(7, 2)).collect()}
    assert got.keys() == want.keys()
    # the operator learns its weights from estimates rounded to quarter powers of two
    for doc_id, score in got.items():
        assert score == pytest.approx(want[doc_id], rel=0.02, abs=0.02), doc_id
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.005)
