"""Quotient filters, and phrases against a plain count."""

import collections
import re

import numpy as np
import pytest
from support import odd_documents

from loomset.llm import collocations
from loomset.llm import quotient_filter as qf


@pytest.mark.parametrize("lanes", [2, 3, 5])
@pytest.mark.parametrize("width", [1, 3, 13, 20, 30, 57])
def test_filters_lose_nothing(lanes, width):
    rng = np.random.default_rng(lanes * width)
    keys = rng.integers(0, 1 << min(width, 5), (lanes, 4000)).astype(np.uint64)
    mixed = qf.permute(keys, width)
    assert (qf.permute(mixed, width, back=True) == keys).all()
    bits, limbs = qf.limb_bits(lanes, width), qf.to_limbs(mixed, width)
    assert (qf.of_limbs(limbs, lanes, width) == mixed).all() and sum(bits) == lanes * width
    range_bits = min(width, 3)
    want = collections.Counter(map(tuple, keys.T.tolist()))
    held = collections.defaultdict(list)
    for part in np.array_split(np.arange(4000), 7):  # seven shards
        found, counts, place = qf.counted([x[part] for x in limbs])
        assert all((f[place] == x[part]).all() for f, x in zip(found, limbs))
        counts = counts * 400  # beyond one byte
        edges = qf.bounds(found[0], bits[0], range_bits)
        for r, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                held[r].append(qf.filter_blob([x[a:b] for x in found], counts[a:b], bits, range_bits))
    got = collections.Counter()
    for r, blobs in held.items():
        filters = [qf.of_filter(b, bits, range_bits, r) for b in blobs]
        found, total, places = qf.merged(filters)
        assert all((f[p] == x).all() for p, (keys_of, _) in zip(places, filters) for f, x in zip(found, keys_of))
        back = qf.permute(qf.of_limbs(found, lanes, width), width, back=True)
        got.update(dict(zip(map(tuple, back.T.tolist()), (total // 400).tolist())))
    assert got == want


def test_filter_space():
    """A filter of n keys takes the remainders' bits and a few bits more, not whole keys."""
    keys = np.random.default_rng(2).integers(0, 1 << 20, (2, 50000)).astype(np.uint64)
    found, counts, _ = qf.counted(qf.to_limbs(qf.permute(keys, 20), 20))
    blob = qf.filter_blob(found, counts, qf.limb_bits(2, 20), 0)
    assert len(blob) < 50000 * (40 - 16 + 8) / 8


def plain(texts, least, first=2000):
    f = collections.defaultdict(collections.Counter)
    for lang, t in texts:
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", t):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        held = {k[i : i + m] for k, v in found.items() for m in range(2, len(k)) for i in range(len(k) - m + 1) if v >= c[k[i : i + m]]}
        scored = []
        for k, a in found.items():
            if k not in held:
                score, cut = min((1000 * a * n // (c[k[:j]] * c[k[j:]]), j) for j in range(1, len(k)))
                scored.append((-score, -a, " ".join(k).encode(), a, c[k[:cut]], c[k[cut:]], n, score))
        out += [(lang, rank + 1, x[2].decode(), *x[3:]) for rank, x in enumerate(sorted(scored)[:first])]
    return sorted(out)


@pytest.mark.parametrize("size", [16 << 20, 60_000])
def test_phrases(spark, monkeypatch, size):
    monkeypatch.setattr(collocations, "PACK", size)
    monkeypatch.setattr(collocations, "BUCKET", size)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    odd = [(i, lang, t) for (i, t), lang in zip(odd_documents() * 2, ["en", None, "und", "x\ny", ""] * 9)]
    odd += [(k, "en", f"New York, NEW york\tnew  york! york.new york{chr(0x1C)} New York") for k in range(30)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, lang string, text string")).selectExpr("*", "lang AS word", "1 AS pack", "doc_id AS ids")
    texts = [(r["lang"], r["text"]) for r in docs.collect()]
    for least, first in ((4, 2000), (20, 3)):
        got = sorted(map(tuple, collocations.mine(docs, least=least, first=first).collect()))
        assert got == plain(texts, least, first)
        assert got


def test_counts_beyond_64_bits(spark):
    """Scores of large counts are exact."""
    phrases = spark.createDataFrame([([1, 2], 4 * 10**12)], "ids array<long>, f long")
    words = spark.createDataFrame([(1, "en", "a", 10**13 + 7), (2, "en", "b", 10**13 + 9)], "id long, lang string, word string, f long")
    totals = spark.createDataFrame([("en", 10**17 + 1)], "lang string, n long")
    original = collocations.frequent_phrases
    collocations.frequent_phrases = lambda *_: (phrases, words, totals)
    try:
        row = collocations.mine(None).first()
    finally:
        collocations.frequent_phrases = original
    assert row["score"] == 1000 * 4 * 10**12 * (10**17 + 1) // ((10**13 + 7) * (10**13 + 9))


def test_none(spark, nothing, odd):
    assert collocations.mine(nothing).collect() == []
    assert collocations.mine(odd, least=10**6).collect() == []
