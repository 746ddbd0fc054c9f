"""The pipeline's stages, each on what its predecessor kept, against plain restatements; and the registered queries."""

import collections
import itertools
import os

import duckdb
import numpy as np
import pytest
from support import odd_documents, rows
from test_brute_force import window_marks

import __spark_entry__
import corpus_pipeline
from loomset.llm import packing, pii, quality_classifier, queries, simhash
from loomset.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's result, written and read again."""
    docs, out = table(spark, SMALL, "documents"), [table(spark, SMALL, "documents")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "pii", "best-fit packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])
    for docs in stages[3:5]:
        assert docs.where("n_chars <> char_length(text)").count() == 0


def test_rejected_documents_go(spark, stages):
    model = quality_classifier.fit(stages[0], table(spark, SMALL, "labels"))
    want = {r["doc_id"] for r in stages[0].collect() if quality_classifier.probability(r["text"].encode(), model) >= 0.5}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert kept == want
    labelled = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    good = [i for i, q in labelled.items() if q == 1]
    assert np.mean([i in kept for i in good]) > 0.97


def test_one_of_each_group_stays(stages):
    prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode()) for r in stages[1].collect()}
    group = {i: i for i in prints}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            group[y] = x
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({find(i) for i in prints})


def test_repeated_passages_go(stages):
    before = [(r["doc_id"], r["text"].encode()) for r in stages[2].collect()]
    want = {i: np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for i, t, gone in window_marks(before)}
    assert {r["doc_id"]: r["text"] for r in stages[3].collect()} == want


def test_personal_data_goes(stages):
    import re

    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    pattern = re.compile(pii.ANY)
    for i, text in before.items():
        # what lies between the matches is the same on both sides
        assert pattern.split(text)[:: pattern.groups + 1] == pattern.split(after[i])[:: pattern.groups + 1]


def test_all_documents_are_packed(stages):
    length = collections.Counter()
    for r in stages[5].collect():
        length[r["doc_id"]] += r["length"]
    ids = packing._ids(queries.vocabulary_path())
    assert length == {r["doc_id"]: len(ids.encode(r["text"])) // 4 + 1 for r in stages[4].collect()}


def test_run_gives_the_last_stage(spark, stages):
    def known(df):
        return sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())

    assert known(corpus_pipeline.run(spark, SMALL)) == known(stages[-1])


@pytest.mark.parametrize("number", range(4))
def test_stages_on_odd_rows_and_on_none(spark, odd, nothing, number, tmp_path):
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, odd, SMALL).dtypes == odd.dtypes
    stage(spark, odd, SMALL).write.parquet(str(tmp_path / "odd"))
    assert stage(spark, nothing, SMALL).collect() == []


def test_repeated_rows_leave_one(spark):
    docs = rows(spark, [(i, t) for i, t in odd_documents() if t] * 2)
    kept = simhash.keep_first(docs).collect()
    assert len(kept) == len({(r["doc_id"], r["text"]) for r in kept}) and {r["doc_id"] for r in kept} >= {1, 15}
    assert not {2} & {r["doc_id"] for r in kept}  # the same text as document 1


def test_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.ORACLE[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False, name=None)))
