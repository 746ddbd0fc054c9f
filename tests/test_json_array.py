"""Splittable chat exports: rows equal to the reader that parses a file in one task, at splits of a few bytes."""

import json
import random

import pytest

from loomset.plans import dataset
from loomset.sources import chat_tree, json_array

PIECES = ["plain", 'quote " in', "brace } and {", "[{]},", "back\\slash\\", '\\"', "}\\u007d", "é日本🎉", "line\nfeed\ttab", "", '"}', " ", '\\\\"}{"']


def _export(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 4)))
    node = lambda: {"message": {"author": {"role": rng.choice(["user", "assistant", "tool{"])}, "content": {"parts": [text(), {"a}": [text()]}, 5][: rng.randint(0, 3)]}}}
    return [{"conversation_id": f"c{k}", "extra": {text(): [text(), {}]}, "mapping": {f"n{j}{text()}": node() for j in range(rng.randint(0, 6))}} for k in range(n)]


@pytest.fixture()
def exports(tmp_dir):
    forms = [dict(), dict(indent=2), dict(ensure_ascii=False), dict(separators=(",", ":"))]
    for k, form in enumerate(forms):
        with open(f"{tmp_dir}/e{k}.json", "w", encoding="utf-8") as out:
            out.write(json.dumps(_export(k, 40), **form) + ("\n \n" if k == 1 else ""))
    for name, body in (("none", "[]"), ("space", " [ \n ] "), ("one", json.dumps(_export(9, 1)))):
        with open(f"{tmp_dir}/{name}.json", "w") as out:
            out.write(body)
    return tmp_dir


def _rows(df):
    cols = df.selectExpr("file", "conversation_id", "to_json(mapping) AS m")
    return sorted(tuple(r) for r in cols.collect())


@pytest.mark.parametrize("split", [53, 1000, 1 << 20])
def test_split_rows_equal_whole_files(spark, exports, split):
    want = _rows(chat_tree.read_chat_tree(spark, exports))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0 if split < 1 << 20 else 4 << 20)
    try:
        got = chat_tree.read_chat_tree(spark, exports, multi_line="split")
        assert _rows(got) == want and len(want) == 161
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_elements_are_numbered_in_order(spark, exports):
    found = json_array.read_elements(spark, f"{exports}/e0.json").orderBy("element").collect()
    assert [r["element"] for r in found] == list(range(40))
    assert [json.loads(r["text"])["conversation_id"] for r in found] == [f"c{k}" for k in range(40)]


@pytest.mark.parametrize("body", ['[{"a": 1} {"a": 2}]', '[{"a": 1}', '[{"a": "x}]', '[{"a": 1}, 5]', '[1, {"a": 1}]', '[{"a": 1}] x', '[{"a": {"b": 1}]', "[[{}]]", "5", '{"a": {"b": 1}\n', '{"a": 1}', '[{"a": {"b": 1}\n'])
def test_no_array_of_objects(spark, tmp_dir, body):
    with open(f"{tmp_dir}/bad.json", "w") as out:
        out.write(body)
    with pytest.raises(Exception):
        json_array.read_elements(spark, f"{tmp_dir}/bad.json").collect()


def test_dataset_from_split_exports(spark, exports, tmp_path):
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    whole = dataset.build_dataset(spark, "chat_tree", exports, one)
    split = dataset.build_dataset(spark, "chat_tree", exports, many, multi_line="split")
    assert {k: v for k, v in whole.items() if k != "output"} == {k: v for k, v in split.items() if k != "output"}
    read = lambda p: sorted(r["value"] for r in spark.read.text(p).collect())
    assert read(one) == read(many) != []
