import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from loomset.operators import formats as FMT
from loomset.plans import dataset
from loomset.sources import jsonl

CONV = "array<struct<role:string,content:string>>"


def _samples(spark):
    conv = spark.createDataFrame(
        [
            ("c5", [("user", "t0"), ("assistant", "t1"), ("user", "t2"), ("assistant", "t3"), ("user", "t4")]),
            ("ca", [("assistant", "first"), ("user", "second")]),
            ("c1", [("user", "only")]),
        ],
        f"id string, conversations {CONV}",
    )
    inst = spark.createDataFrame([("i1", "Elaborate: ü", "", "naïve text 日本")], "id string, instruction string, input string, output string")
    return FMT.conversation_samples(conv, F.col("id"), "t").unionByName(FMT.instruction_samples(inst, F.col("id"), "t"))


def _records(df):
    return {r.sample_id: json.loads(r.record) for r in df.collect()}


def test_sharegpt(spark):
    recs = _records(FMT.to_sharegpt(_samples(spark)))
    assert recs["i1"] == {"conversations": [{"role": "user", "content": "Elaborate: ü"}, {"role": "assistant", "content": "naïve text 日本"}]}
    assert len(recs["c5"]["conversations"]) == 5 and set(recs) == {"c5", "ca", "c1", "i1"}


def test_alpaca(spark):
    recs = _records(FMT.to_alpaca(_samples(spark)))
    assert recs["c5"] == {"instruction": "t0", "input": "", "output": "t1"}
    assert recs["ca"] == {"instruction": "first", "input": "", "output": "second"}
    assert "c1" not in recs
    assert recs["i1"] == {"instruction": "Elaborate: ü", "input": "", "output": "naïve text 日本"}


def test_jsonl_raw_and_unescaped(spark, tmp_dir):
    out = f"{tmp_dir}/out"
    jsonl.write_jsonl(FMT.to_jsonl(_samples(spark)), out)
    text = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{out}/part-*"))
    assert "日本" in text and "\\u" not in text
    lines = [json.loads(line) for line in text.splitlines()]
    assert {"instruction": "Elaborate: ü", "input": "", "output": "naïve text 日本"} in lines
    assert sum("conversations" in x for x in lines) == 3


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        FMT.format_samples(_samples(spark), "openai")


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.mark.parametrize("guard,redact", [(True, True), (False, True), (True, False)])
def test_build_dataset_log_summary_and_toggles(spark, tmp_dir, guard, redact):
    lines = [f"[1/2/24, 10:00:00 AM] P{i % 2}: msg {i} 555-123-4567" for i in range(13)]
    lines[3] = "[1/2/24, 10:00:00 AM] P1: ddos attack plan"
    lines[5] = "[1/2/24, 10:00:00 AM] P1: nsfw content"
    _write(f"{tmp_dir}/logs/a.txt", "\n".join(lines))
    out = f"{tmp_dir}/ds"
    summary = dataset.build_dataset(spark, "message_log", f"{tmp_dir}/logs", out, "sharegpt", redact, guard)
    kept = 13 - (2 if guard else 0)
    assert summary["samples"] == kept // 6 + (1 if kept % 6 >= 2 else 0)
    assert (summary["hacking"], summary["sexual"], summary["rejected"]) == ((1, 1, 2) if guard else (0, 0, 0))
    recs = [json.loads(x.record) for x in jsonl.read_jsonl(spark, out).collect()]
    assert len(recs) == summary["samples"]
    body = json.dumps(recs)
    assert ("[REDACTED_PHONE]" in body) == redact and ("555-123-4567" in body) == (not redact)


def test_build_dataset_notes_and_chat_tree(spark, tmp_dir):
    _write(f"{tmp_dir}/notes/x/a.md", "word " * 30)
    _write(f"{tmp_dir}/notes/b.txt", "pornography " * 10)
    s = dataset.build_dataset(spark, "notes", f"{tmp_dir}/notes", f"{tmp_dir}/o1", "alpaca")
    assert (s["samples"], s["sexual"], s["rejected"]) == (1, 1, 1)
    tree = [{"mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}},
                         "b": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["a"]}}}}}]
    _write(f"{tmp_dir}/tree/t.json", json.dumps(tree))
    s = dataset.build_dataset(spark, "chat_tree", f"{tmp_dir}/tree", f"{tmp_dir}/o2", "alpaca")
    assert s["samples"] == 1 and s["rejected"] == 0
    rec = json.loads(jsonl.read_jsonl(spark, f"{tmp_dir}/o2").first().record)
    assert rec == {"instruction": "q", "input": "", "output": "a"}


def test_build_dataset_zero_samples(spark, tmp_dir):
    _write(f"{tmp_dir}/z/a.txt", "too short")
    s = dataset.build_dataset(spark, "notes", f"{tmp_dir}/z", f"{tmp_dir}/o3")
    assert s["samples"] == 0 and s["rejected"] == 0


def test_command_line(spark, tmp_dir):
    from loomset.__main__ import main

    _write(f"{tmp_dir}/cli/a.txt", "note " * 20 + "call 555-123-4567")
    s = main(["--kind", "notes", "--input", f"{tmp_dir}/cli", "--output", f"{tmp_dir}/cli-out", "--format", "alpaca"])
    assert s["samples"] == 1
    rec = json.loads(jsonl.read_jsonl(spark, f"{tmp_dir}/cli-out").first().record)
    assert rec["output"].endswith("[REDACTED_PHONE]")


def test_command_line_explain(spark, tmp_dir, capsys):
    from loomset.__main__ import main

    _write(f"{tmp_dir}/ex/a.txt", "note " * 20)
    assert main(["--kind", "notes", "--input", f"{tmp_dir}/ex", "--output", f"{tmp_dir}/ex-out", "--explain"]) == {}
    out = capsys.readouterr().out
    assert "Physical Plan" in out and "Exchange" not in out
    assert not os.path.exists(f"{tmp_dir}/ex-out")


def test_compressed_output(spark, tmp_dir):
    _write(f"{tmp_dir}/gz/a.txt", "zipped note " * 10)
    s = dataset.build_dataset(spark, "notes", f"{tmp_dir}/gz", f"{tmp_dir}/gz-out", "alpaca", compression="gzip")
    assert s["samples"] == 1
    assert glob.glob(f"{tmp_dir}/gz-out/part-*.gz")
    assert json.loads(jsonl.read_jsonl(spark, f"{tmp_dir}/gz-out").first().record)["output"].startswith("zipped note")


def test_chunk_words_must_be_positive(spark, tmp_dir):
    _write(f"{tmp_dir}/cw/a.txt", "x " * 100)
    with pytest.raises(ValueError):
        dataset.read_samples(spark, "notes", f"{tmp_dir}/cw", chunk_words=0)


def test_a_run_without_samples_leaves_an_earlier_dataset_alone(spark, tmp_dir):
    import os

    from loomset.plans import dataset
    from loomset.sources import jsonl

    def note(folder, text):
        os.makedirs(f"{tmp_dir}/{folder}", exist_ok=True)
        with open(f"{tmp_dir}/{folder}/a.txt", "w") as f:
            f.write(text)
        return f"{tmp_dir}/{folder}"

    full, empty = note("full", "some words of a note " * 5), note("empty", "short")
    out = f"{tmp_dir}/out"
    assert dataset.build_dataset(spark, "notes", empty, out)["samples"] == 0
    assert jsonl.read_jsonl(spark, out).count() == 0 and os.path.isdir(out)  # a new path: an empty folder
    assert dataset.build_dataset(spark, "notes", full, out)["samples"] == 1
    assert dataset.build_dataset(spark, "notes", empty, out)["samples"] == 0
    assert jsonl.read_jsonl(spark, out).count() == 1
    assert dataset.build_dataset(spark, "notes", note("other", "other words of a note " * 6), out)["samples"] == 1
    assert "other" in jsonl.read_jsonl(spark, out).first()["record"]
    assert [d for d in os.listdir(tmp_dir) if "staged" in d] == []
