"""Redaction in linear time with the original's matches; defined order of table logs; repeated node ids; safe replacement."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.plans import dataset
from loomset.sources import chat_tree, jsonl


@pytest.mark.parametrize("alphabet", ["ab1.@_%- c@x.", "a@.b", "xY9._%+-@é١\n", "com.@-"])
def test_email_rewrite_has_pythons_matches(spark, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(30000)]
    texts += ["a@b.com_x@d.org", "a@b.comc@d.org", "a@b.co.uk@x.yy", "a@b.com@c.dd"]
    original = re.compile(rules.PII_PATTERNS["email"])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.redact_step("email", F.col("t")).alias("out")).collect()
    assert all(r["out"] == original.sub(rules.PII_REPLACEMENTS["email"], r["t"]) for r in got)
    assert any("REDACTED" in r["out"] for r in got)


def test_only_exact_cases_are_rewritten():
    assert rules.from_run_starts(r"[ab]+@c") == r"(?:(?<![ab])|\G)[ab]++@c"
    for kept in (r"[ab@]+@c", r"[ab]+\.c", r"[ab]+", r"x[ab]+@", r"[^ab]+c", r"[ab]+(?:@c)"):
        assert rules.from_run_starts(kept) == kept


MILLION = 1_000_000
LONG = {
    "letters": "a" * MILLION,
    "letters and @": "a" * MILLION + " x@y",
    "digits": "1" * MILLION,
    "digits and @": "1" * MILLION + "@",
    "labels": "a@" + "b." * (MILLION // 2) + "1",
    "many @": "a@" * (MILLION // 2),
    "dots": "a." * (MILLION // 2),
    "octets": "1." * (MILLION // 2),
    "key": "sk-" + "a" * MILLION + "é",
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_without_a_break(spark, name):
    df = spark.createDataFrame([(LONG[name],)], "t string").cache()
    df.count()
    df.limit(1).select(F.length(T.redact_guarded(F.lit("a@b.cc")))).collect()  # plans and classes are warm
    start = time.perf_counter()
    out = df.select(T.redact(F.col("t")).alias("plain"), T.redact_guarded(F.col("t")).alias("guarded")).first()
    assert time.perf_counter() - start < 10  # quadratic: hours
    assert out["plain"] == out["guarded"]


def _windows(lines, **options):
    out = dataset.table_log_samples(lines, "log", "pos", "who", "text", **options)
    return sorted(json.dumps([m.asDict() for m in r["conversations"]]) for r in out.collect())


def test_table_logs_do_not_depend_on_blocks(spark):
    """Null, repeated, negative and sparse order values: the same windows with one block and with many."""
    rng = random.Random(3)
    rows = [("a", pos, f"p{k % 3}", f"text {k}") for k, pos in enumerate([None, None, 5, 5, 5, -7, 0, 10**12, 3, None, *range(100, 160, 7)] * 3)]
    rows += [("b", None, "x", f"only {k % 4}") for k in range(9)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "log string, pos long, who string, text string")
    want = _windows(lines)
    assert len(want) == 57 // 6 + (57 % 6 >= 2) + 2
    for size in (1, 4, 50):
        assert _windows(lines.repartition(5), block_size=size) == want
    first = json.loads(next(w for w in want if "only" in w))
    assert first[0]["role"] == "user"


def _nodes(spark, tmp_dir, pairs):
    """One conversation whose JSON object repeats node ids."""
    node = lambda t: json.dumps({"message": {"author": {"role": "user"}, "content": {"parts": [t]}}})
    body = ", ".join(f"{json.dumps(k)}: {node(t)}" for k, t in pairs)
    path = f"{tmp_dir}/export.json"
    with open(path, "w") as out:
        out.write(f'[{{"mapping": {{{body}}}}}]')
    return path


def test_repeated_node_ids(spark, tmp_dir):
    rng = random.Random(1)
    pairs = [(f"n{rng.randint(0, 40)}", f"t{k}") for k in range(120)]
    df = chat_tree.read_chat_tree(spark, _nodes(spark, tmp_dir, pairs))
    got = df.select(chat_tree.node_messages(F.col("mapping")).alias("m")).first()["m"]
    assert [m["content"] for m in got] == list(dict(pairs).values())


def test_one_repeated_id_in_a_large_tree(spark, tmp_dir):
    pairs = [(f"n{k}", f"t{k}") for k in range(100_000)] + [("n5", "last")]
    df = chat_tree.read_chat_tree(spark, _nodes(spark, tmp_dir, pairs))
    start = time.perf_counter()
    got = df.select(chat_tree.node_messages(F.col("mapping")).alias("m")).first()["m"]
    assert time.perf_counter() - start < 60
    assert len(got) == 100_000 and got[5]["content"] == "last"


def _records(spark, word):
    return spark.createDataFrame([(word,)], "record string")


def _read(spark, path):
    return [r["record"] for r in jsonl.read_jsonl(spark, path).collect()]


def test_replacement_that_breaks_off(spark, tmp_dir, monkeypatch):
    target, staged = f"{tmp_dir}/set", f"{tmp_dir}/new"
    jsonl.write_jsonl(_records(spark, "old"), target)
    # the new folder is missing, so the second move fails
    with pytest.raises(Exception):
        jsonl.replace(spark, staged, target, keep_target=False)
    assert _read(spark, target) == ["old"]
    # the job ends between the two moves
    where, fs = jsonl._folder(spark, target)
    assert fs.rename(where, jsonl._aside(spark, target))
    assert _read(spark, target) == ["old"] and jsonl.exists(spark, target)
    # the job ends before the earlier dataset is deleted
    jsonl.write_jsonl(_records(spark, "older"), f"{tmp_dir}/_replaced-set")
    jsonl.write_jsonl(_records(spark, "new"), staged)
    jsonl.replace(spark, staged, target, keep_target=False)
    assert _read(spark, target) == ["new"] and not fs.exists(jsonl._aside(spark, target))
