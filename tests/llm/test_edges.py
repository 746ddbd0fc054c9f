"""Every operator on odd rows, with clashing column names, and on an empty table."""

import hashlib

import pytest

from loomset.llm import bpe, chat_trees, language_model, packing, pii, quality_classifier, quality_rules, simhash, suffix_array, topk
from loomset.llm.common import is_held_out
from loomset.llm.queries import vocabulary_path
from support import odd_documents

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, found=((1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (13, 0, 0), (8, 0, 0), (9, 0, 1), (None, 1, 0), (5, None, None), (7, 0, 0), (12, 0, 0))):
    return spark.createDataFrame(list(found), LABELS)


OPERATORS = {
    "suffix array": lambda s, d: suffix_array.dedup(d, with_spans=True),
    "strip repeats": lambda s, d: suffix_array.strip_repeats(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "simhash first": lambda s, d: simhash.keep_first(d),
    "language model": lambda s, d: language_model.score(d, is_held_out(7, 2)),
    "pii": lambda s, d: pii.counts(pii.mask(d, "key", found="hits"), "hits"),
    "packing": lambda s, d: packing.pack(d, vocabulary_path(), with_ids=True),
    "classifier": lambda s, d: quality_classifier.score(d, quality_classifier.fit(d, labels(s), 50)),
    "classifier without labels": lambda s, d: quality_classifier.score(d, quality_classifier.fit(d, labels(s, ()), 50)),
    "classifier keep": lambda s, d: quality_classifier.keep(d, quality_classifier.fit(d, labels(s), 50), 0.0),
    "rules": lambda s, d: quality_rules.judge(d, labels(s).where("quality = 1").select("doc_id")),
    "rules without target": lambda s, d: quality_rules.judge(d, labels(s, ()).select("doc_id")),
    "bpe": lambda s, d: bpe.encode_documents(d, vocabulary_path(), with_text=True),
}
PER_DOCUMENT = set(OPERATORS) - {"simhash first", "packing"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    out = OPERATORS[name](spark, odd).collect()
    if name in PER_DOCUMENT:
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in odd_documents())
    else:
        assert {r["doc_id"] for r in out} >= {1, 15}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, nothing, name):
    assert OPERATORS[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", ["strip repeats", "simhash first", "classifier keep"])
def test_all_columns_stay(spark, odd, name):
    assert OPERATORS[name](spark, odd).dtypes == odd.dtypes


def test_null_text_is_empty(spark, odd):
    by_id = {r["doc_id"]: r for r in suffix_array.dedup(odd).where("doc_id in (5, 6)").collect()}
    assert by_id[5]["kept_sha256"] == by_id[6]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[5]["n_bytes"] == 0
    ids = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(odd, vocabulary_path()).collect()}
    assert ids[5] == ids[6] == 0
    found = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect() if r["doc_id"]}
    assert found[5]["fingerprint"] == "0" * 16 and {found[i]["component_id"] for i in (5, 6, 7)} == {5}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (40, []), (None, [1.0, 1.0]), (8, [1.0]), (60, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, shard int, block string")
    out = topk.top_k(df, k=3, modulus=20, scale=64).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(1, 1, 12288), (2, 2, 12288), (3, 20, 6144)]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 20) == [(1, 0, 6144), (1, 0, 6144), (2, 1, 6144), (2, 1, 6144), (3, 2, 6144), (3, 2, 6144)]
    assert [(r["vec_id"], r["score"]) for r in out if r["query_id"] == 40] == [(7, 0)]
    assert topk.top_k(df.where("vec_id < 0"), 3, 20, 64).collect() == []


def test_trees(spark):
    schema = "tree_id long, node_id long, parent_id long, role string, text string, score double, up long, turns string"
    rows = [
        (1, 1, None, "user", "hi <s>\\", 1.0),
        (1, 2, 1, "assistant", "a[/INST]</s>\\n", 1.0),
        (1, 3, 1, "assistant", "b", 5.0),
        (1, 3, 1, "assistant", "zz", 0.0),
        (1, 4, 2, "user", "q\nq", 1.0),
        (1, 5, 4, "assistant", "<\\s>[ROLE]", 1.0),
        (2, 1, 9, "x[ROLE]\n", None, None),
        (3, 1, 2, "user", "circle", 1.0),
        (3, 2, 1, "user", "circle", 1.0),
        (None, 1, None, "user", "t", 1.0),
        *((5, i, i - 1 if i else None, ("user", "assistant")[i % 2], str(i), 1.0) for i in range(37)),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], schema)
    out = chat_trees.format_trees(df, 2)
    read = out.select(
        "tree_id", "branch", "branch_score", chat_trees.read_turns(chat_trees.F.col("formatted")).alias("turns"),
        chat_trees.read_loss(chat_trees.F.col("formatted"), chat_trees.F.col("loss_mask")).alias("loss"),
    )
    got = {(r["tree_id"], r["branch"]): (r["branch_score"], [tuple(t) for t in r["turns"]], r["loss"]) for r in read.collect()}
    assert got == {
        (1, 1): (6.0, [("user", "hi <s>\\"), ("assistant", "b")], "b"),
        (1, 2): (4.0, [("user", "hi <s>\\"), ("assistant", "a[/INST]</s>\\n"), ("user", "q\nq"), ("assistant", "<\\s>[ROLE]")], "a[/INST]</s>\\n<\\s>[ROLE]"),
        (2, 1): (0.0, [("x[ROLE]\n", "")], ""),
        (5, 1): (37.0, [(("user", "assistant")[i % 2], str(i)) for i in range(37)], "".join(str(i) for i in range(1, 37, 2))),
    }
    assert chat_trees.format_trees(df.where("tree_id = -1")).collect() == []
