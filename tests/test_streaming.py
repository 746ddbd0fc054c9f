import glob
import json
import os

from loomset.streaming.notes_stream import run_notes_available_now


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _records(out):
    return [json.loads(line) for p in glob.glob(f"{out}/part-*") for line in open(p, encoding="utf-8") if line.strip()]


def test_notes_stream_incremental_exactly_once(spark, tmp_dir):
    src, out, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    _write(f"{src}/a.txt", "alpha " * 20 + "mail a@b.co")
    _write(f"{src}/sub/b.md", "ransomware " * 10)
    _write(f"{src}/c.csv", "ignored " * 20)
    batches = run_notes_available_now(spark, src, out, ckpt, dataset_format="alpaca")
    recs = _records(out)
    assert len(recs) == 1 and recs[0]["output"].endswith("[REDACTED_EMAIL]")
    assert sum(b["hacking"] for b in batches) == 1
    _write(f"{src}/d.txt", "delta " * 20)
    run_notes_available_now(spark, src, out, ckpt, dataset_format="alpaca")
    recs = _records(out)
    assert len(recs) == 2 and sorted(r["instruction"][-5:] for r in recs) == ["a.txt", "d.txt"]


def test_notes_stream_bounded_batches(spark, tmp_dir):
    src, out, ckpt = f"{tmp_dir}/in2", f"{tmp_dir}/out2", f"{tmp_dir}/ckpt2"
    for i in range(5):
        _write(f"{src}/n{i}.md", f"note {i} " * 20)
    batches = run_notes_available_now(spark, src, out, ckpt, max_files_per_trigger=2)
    assert len(batches) == 3  # 2 + 2 + 1 files
    assert len(_records(out)) == 5


def test_counts_of_more_batches_than_spark_keeps(spark, tmp_dir):
    src, out, ckpt = f"{tmp_dir}/in3", f"{tmp_dir}/out3", f"{tmp_dir}/ckpt3"
    for i in range(6):
        _write(f"{src}/n{i}.md", "ransomware " * 10)
    name = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(name, "3")
    try:
        batches = run_notes_available_now(spark, src, out, ckpt, max_files_per_trigger=1)
        assert spark.conf.get(name) == "3"
    finally:
        spark.conf.unset(name)
    assert len(batches) == 6 and sum(b["hacking"] for b in batches) == 6


def test_stream_refuses_hidden_notes(spark, tmp_dir):
    import pytest

    _write(f"{tmp_dir}/in4/_drafts/a.md", "words " * 20)
    with pytest.raises(ValueError, match="names"):
        run_notes_available_now(spark, f"{tmp_dir}/in4", f"{tmp_dir}/out4", f"{tmp_dir}/ckpt4")
