"""The stream's driver holds listings, not notes; every note is taken up once, whatever its name, its date or the way of the run."""

import os

import pytest
from loomset.streaming import notes_stream
from loomset.streaming.notes_stream import notes_stream_writer, run_notes_available_now
from pyspark.sql import functions as F
from test_notes_driver import _odd, _spark_reads, _write


def test_stream_holds_listings_not_notes(spark, tmp_dir):
    """A run over odd names and several batches, a second one with late notes of old dates, and nothing new in a third."""
    top, out, at = _odd(f"{tmp_dir}/n"), f"{tmp_dir}/o", f"{tmp_dir}/c"
    run = lambda: run_notes_available_now(spark, top, out, at, max_files_per_trigger=4, hidden="skip", dataset_format="alpaca")
    names = lambda: sorted(r.n for r in spark.read.text(out).select(F.regexp_extract(F.get_json_object("value", "$.instruction"), "regarding: (?s)(.*)$", 1).alias("n")).collect())
    batches = run()
    want = [name for _, name, text in _spark_reads(spark, top)]
    assert sorted(b["notes_read"] for b in batches) == [3, 4, 4, 4] and len(want) == 15
    taken = [line for f in os.listdir(f"{at}/sources/0") if not f.startswith(".") for line in open(f"{at}/sources/0/{f}")]
    assert sum("listings/run-" in line for line in taken) == 4 and not any(".md" in line for line in taken)
    kept = names()
    assert set(kept) <= set(want)
    for k in range(2):
        _write(f"{top}/late{k}.md")
        os.utime(f"{top}/late{k}.md", (86400, 86400))  # older than Spark's source would take up
    os.makedirs(f"{at}/listings/_staged-broken-off/batch=0")
    with open(f"{at}/listings/_staged-broken-off/batch=0/part-0.parquet", "w") as f:
        f.write("not whole")
    assert sum(b["notes_read"] for b in run()) == 2
    assert sum(b["notes_read"] for b in run()) == 0
    assert names() == sorted([*kept, "late0.md", "late1.md"])


def test_listed_but_not_streamed_notes_are_streamed_once(spark, tmp_dir):
    for k in range(3):
        _write(f"{tmp_dir}/n/{k}.md")
    assert notes_stream.list_new_notes(spark, f"{tmp_dir}/n", f"{tmp_dir}/c", 2)  # a run that ended here
    _write(f"{tmp_dir}/n/3.md")
    assert notes_stream._largest_batch(spark, f"{tmp_dir}/c")[0] == 2
    batches = run_notes_available_now(spark, f"{tmp_dir}/n", f"{tmp_dir}/o", f"{tmp_dir}/c", max_files_per_trigger=None)
    assert sorted(b["notes_read"] for b in batches) == [1, 1, 2] and spark.read.text(f"{tmp_dir}/o").count() == 4
    assert notes_stream._largest_batch(spark, f"{tmp_dir}/c") == (0, 0)


def test_checkpoints_go_on_as_they_began(spark, tmp_dir):
    _write(f"{tmp_dir}/n/a.md")
    start = lambda out, at: notes_stream_writer(spark, f"{tmp_dir}/n", out, checkpoint=at).trigger(availableNow=True).start()
    start(f"{tmp_dir}/o", f"{tmp_dir}/c").awaitTermination()
    _write(f"{tmp_dir}/n/b.md")
    run_notes_available_now(spark, f"{tmp_dir}/n", f"{tmp_dir}/o", f"{tmp_dir}/c")
    assert spark.read.text(f"{tmp_dir}/o").count() == 2 and not os.path.exists(f"{tmp_dir}/c/listings")
    run_notes_available_now(spark, f"{tmp_dir}/n", f"{tmp_dir}/o2", f"{tmp_dir}/c2")
    with pytest.raises(ValueError, match="listings"):
        start(f"{tmp_dir}/o2", f"{tmp_dir}/c2")
