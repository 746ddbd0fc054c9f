"""Hard negatives and top-k against plain products of Python integers."""

import collections
import math

import numpy as np
import pytest

from loomset.llm import hard_negatives, topk, wholevec

SCHEMA = "vec_id long, embedding array<double>, label int, width int, block string, slot int"


def frame(spark, found):
    return spark.createDataFrame([(i, v, l, 7, "x", 1) for i, v, l in found], SCHEMA)


def whole(found, scale):
    return [(i, l, [math.floor(scale * x) for x in v]) for i, v, l in found if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain(found, modulus, positives=5, negatives=10):
    there = [r for r in whole(found, 256) if r[1] is not None]
    out = collections.Counter()
    for i, l, v in there:
        if i % modulus == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in there if j != i and len(w) == len(v)]
            for p, j in sorted((s, j) for s, j, m in scores if m == l)[:positives]:
                own = sorted((s, n) for s, n, m in scores if m != l and 30 * -p <= 100 * -s <= 90 * -p)[:negatives]
                out.update((i, j, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(own))
    return out


def mined(spark, found, modulus):
    return collections.Counter(map(tuple, hard_negatives.mine(frame(spark, found), modulus=modulus).collect()))


@pytest.mark.parametrize("sizes", [(8192, 4096, 32), (37, 20, 3)])
def test_provided_vectors(spark, monkeypatch, sizes):
    for name, size in zip(("SHARD", "BLOCK", "GROUP"), sizes):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    found = [tuple(r) for r in rows]
    assert mined(spark, found, 10) == plain(found, 10) != collections.Counter()


def test_ties_repeats_and_large_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 16)
    rng = np.random.default_rng(0)
    found = [
        (int(rng.integers(0, 60)), [float(x) for x in rng.integers(-3, 4, 3) * 10.0 ** rng.integers(0, 6 if k % 3 else 7)], int(rng.integers(0, 3)))
        for k in range(150)
    ]
    found += [(1, [1e300, 0.0, 0.0], 7), (2, [1e-300, 1.0, 1.0], 1), (5, [], 1), (10, [], 1), (15, [2.0], 0), (20, [1.0], 0), (4, [1.5], 1)]
    found += [(30, None, 1), (None, [1.0, 1.0, 1.0], 1), (35, [None, 1.0, 2.0], 1), (40, [math.nan, 1.0, 1.0], 1), (45, [math.inf, 0.0, 0.0], 2), (50, [1.0, 1.0, 1.0], None)]
    assert mined(spark, found, 5) == plain(found, 5) != collections.Counter()


def test_score_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="64-bit"):
        mined(spark, [(100, [1e10], 1), (1, [1e10], 1), (2, [1.0], 0)], 100)


def test_no_rows(spark):
    assert mined(spark, [], 5) == collections.Counter()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], 5) == collections.Counter()  # no anchor


def test_slots_are_disjoint_and_suffixes_answer():
    """One anchor with limits 90, 60, 60, 30: what every slot keeps gives each window's best."""
    block = hard_negatives.Block([wholevec.to_blob(np.array([0]), np.array([0]), np.array([[1.0]]), 1)], 1)
    limits = [{"number": 0, "slot": j, "low": low, "high": high} for j, (low, high) in enumerate([(30, 90), (20, 60), (20, 60), (10, 30)])]
    slots = hard_negatives.Slots(block, limits, 5, 2)
    for part in np.array_split(np.arange(100), 9):
        slots.meet(part + 1, np.ones(len(part), np.int64), part[:, None])
    _, _, slot, _, score = slots.rows()
    assert sorted(zip(slot.tolist(), score)) == [(0, 89), (0, 90), (2, 59), (2, 60), (3, 29), (3, 30)]


def nearest(found, k, modulus, scale):
    there = whole(found, scale)
    out = collections.Counter()
    for i, _, v in there:
        if i % modulus == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, _, w in there if j != i and len(w) == len(v))[:k]
            out.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(best))
    return out


def test_top_k_keeps_large_vectors(spark, monkeypatch):
    found = [(20, [1.0, 2.0], 0), (1, [2e6, 1.0], 0), (2, [1.0, 1.0], 0), (40, [2e6, 3.0], 0)]
    got = collections.Counter(map(tuple, topk.top_k(frame(spark, found), 3, 20, 64).collect()))
    assert got == nearest(found, 3, 20, 64) and sum(got.values()) == 6
    monkeypatch.setattr(topk, "SHARD", 200)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(4)
    for size in (1e3, 1e5, 1e6, 5e6):
        found = [(k, (rng.standard_normal(4) * size).tolist(), 0) for k in range(600)]
        found += [(700, [1e12, 0.0, 1e-9, 0.0], 0), (701, [0.0, 0.0, 1e12, -1.0], 0)] if size == 1e3 else []
        got = collections.Counter(map(tuple, topk.top_k(frame(spark, found).repartition(5), 4, 30, 64).collect()))
        assert got == nearest(found, 4, 30, 64)


def test_top_k_score_that_fits_no_long(spark):
    found = [(20, [1e12], 0), (1, [1e12], 0), (2, [1.0], 0), (3, [-1e12], 0)]
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(frame(spark, found), 1, 20, 64).collect()
    found[1] = (1, [2.0], 0)
    got = sorted(map(tuple, topk.top_k(frame(spark, found), 2, 20, 64).collect()))
    assert got == [(20, 1, 1, 128 * 64 * 10**12), (20, 2, 2, 64 * 64 * 10**12)]  # the lowest is under all longs, and not asked for
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(frame(spark, found), 3, 20, 64).collect()
