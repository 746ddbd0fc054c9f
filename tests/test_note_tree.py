"""Notes listed and read by executors, hidden names included, and the names of notes that cannot be read."""

import os

import pytest
from pyspark.sql import functions as F

from loomset.plans import dataset
from loomset.sources import note_tree, notes

NAMES = ("a.txt", "sub/b.md", "sub/_u.md", ".x.md", "_posts/2024/c.txt", "sub/.git/config", "_SUCCESS", "sub/deep/.d/e.json",
         "C.TXT", "e.csv", "a b/50%#?.md", "ü/é[1].txt", "x=1/_k=v.md", "lang=en/part.txt")


def _write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def _tree(top):
    for name in NAMES:
        _write(f"{top}/{name}", f"the note {name} says this and that of it " * 3)
    return top


def _walk(top):
    """What an ``os.walk`` with the extension filter reads: name and text."""
    found = []
    for folder, _, files in os.walk(top):
        for name in files:
            if name.endswith((".txt", ".md", ".json")):
                with open(f"{folder}/{name}", encoding="utf-8", errors="ignore", newline="") as f:
                    found.append((name, f.read()))
    return sorted(found)


def test_every_name_is_read(spark, tmp_dir):
    top = _tree(f"{tmp_dir}/n")
    _write(f"{top}/empty.md", "")
    _write(f"{top}/bad.txt", b"a\xff\xc3(b\xe2\x82 end \xef\xbf\xbd")
    _write(f"{top}/mark.json", b"\xef\xbb\xbf{}\r\n")
    got = sorted((r.file_name, r.text) for r in notes.read_notes(spark, top, hidden="read").collect())
    assert got == _walk(top)
    hidden = [r.inner for r in note_tree.list_notes(spark, top).where("hidden").orderBy("inner").collect()]
    assert hidden == [".x.md", "_posts/2024/c.txt", "sub/_u.md", "sub/deep/.d/e.json", "x=1/_k=v.md"]


def test_names_and_texts_are_those_of_sparks_reader(spark, tmp_dir):
    top = _tree(f"{tmp_dir}/a n")
    plain = notes.read_notes(spark, top, hidden="skip").where(~F.col("file_path").contains("_k=v"))
    ours = note_tree.note_rows(note_tree.read_listed(note_tree.list_notes(spark, top).where("not hidden")))
    assert sorted((r.file_name, r.text) for r in ours.collect()) == sorted((r.file_name, r.text) for r in plain.collect())
    assert {r.file_path.split("/a n/")[1] for r in ours.collect()} >= {"a b/50%#?.md", "ü/é[1].txt", "sub/b.md"}


def test_instructions_name_files_as_they_are_called(spark, tmp_dir):
    for name in ("my notes.md", "a+b 50%.txt", "ü%20.md"):
        _write(f"{tmp_dir}/n/{name}", "some words of a note " * 5)
    for hidden in ("error", "read"):
        samples = dataset.read_samples(spark, "notes", f"{tmp_dir}/n", hidden=hidden)
        names = sorted(r.instruction.split("regarding: ")[1] for r in samples.collect())
        assert names == ["a+b 50%.txt", "my notes.md", "ü%20.md"]


def test_listing_runs_in_tasks_and_reads_in_many(spark, tmp_dir):
    top = f"{tmp_dir}/n"
    for k in range(200):
        _write(f"{top}/{k % 20}/{k}.txt", f"note {k}")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        read = note_tree.read_listed(note_tree.list_notes(spark, top))
        assert read.select(F.spark_partition_id()).distinct().count() > 16
        assert read.count() == 200
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_roots(spark, tmp_dir):
    top = _tree(f"{tmp_dir}/n")
    one = notes.read_notes(spark, f"{top}/.x.md", hidden="read").collect()
    assert [r.file_name for r in one] == [".x.md"]
    assert notes.read_notes(spark, f"{top}/e.csv", hidden="read").count() == 0
    assert notes.read_notes(spark, [f"{top}/sub", f"{top}/_posts"], hidden="read").count() == 4
    assert notes.read_notes(spark, f"{top}/s*b", hidden="read").count() == 3
    os.makedirs(f"{tmp_dir}/none/below")
    assert notes.read_notes(spark, f"{tmp_dir}/none", hidden="read").count() == 0
    with pytest.raises(FileNotFoundError):
        notes.read_notes(spark, f"{tmp_dir}/absent", hidden="read")


def test_links(spark, tmp_dir):
    top = f"{tmp_dir}/n"
    _write(f"{top}/a.txt", "one")
    os.symlink(top, f"{top}/again")
    os.symlink(f"{top}/a.txt", f"{top}/b.txt")
    os.symlink(f"{top}/gone.txt", f"{top}/c.txt")
    assert sorted(r.file_name for r in notes.read_notes(spark, top, hidden="read").collect()) == ["a.txt", "b.txt"]


def test_unreadable_notes_are_named(spark, tmp_dir):
    top = _tree(f"{tmp_dir}/n")
    listed = note_tree.list_notes(spark, top)
    os.remove(f"{top}/sub/_u.md")  # listed, but gone when it is to be read
    read = note_tree.read_listed(listed)
    failed = read.where("error is not null").collect()
    assert [r.inner for r in failed] == ["sub/_u.md"] and failed[0].content is None
    assert note_tree.note_rows(read).count() == listed.count() - 1
    with pytest.raises(Exception, match="_u.md"):
        note_tree.read_listed(listed, skip_unreadable=False).count()


def test_dataset_over_every_name(spark, tmp_dir):
    top = _tree(f"{tmp_dir}/n")
    summary = dataset.build_dataset(spark, "notes", top, f"{tmp_dir}/out", "alpaca", hidden="read")
    assert summary["samples"] == len(_walk(top)) == summary["notes_read"]
    assert (summary["skipped_files"], summary["skipped_names"]) == (0, [])


def test_summary_names_what_was_skipped(spark, tmp_dir, monkeypatch):
    top = _tree(f"{tmp_dir}/n")
    real = note_tree.list_notes

    def with_a_lost_one(spark, path):
        listed = real(spark, path)
        return listed.unionAll(listed.where("inner = 'a.txt'").withColumn("inner", F.lit("lost.md")))

    monkeypatch.setattr(note_tree, "list_notes", with_a_lost_one)
    summary = dataset.build_dataset(spark, "notes", top, f"{tmp_dir}/out", "alpaca", hidden="read")
    assert summary["skipped_files"] == 1
    assert [n.rsplit("/", 1)[1] for n in summary["skipped_names"]] == ["lost.md"]
