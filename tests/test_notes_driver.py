"""Notes are listed by tasks: the driver holds no file, and the rows are those of Spark's reader."""

import os

import pytest
from loomset.sources import note_tree, notes
from loomset.streaming.notes_stream import run_notes_available_now

ODD = ("a b/50%#?.md", "ü/é[1].txt", "q'\"<>^`{}|~!$&()*+,;=@.md", "time/10:30.md", "back\\slash.md", "tab\t.md", "nb\xa0sp　.md", "c\x85trl.md", "\U0001f600.md",
       "x._COPYING_/a.md", "_metadata_x/b.md", "_k=v/c.md", "_metadata.md", "_u/d.md", ".git/e.md", "sub/_z=.md", "sub/deep/f.json", "g.csv")


def _write(path, text="some words of a note " * 5):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _odd(top):
    for name in ODD:
        _write(f"{top}/{name}", f"the note {name}")
    _write(f"{top}/empty.md", "")
    with open(f"{top}/bytes.md", "wb") as f:
        f.write(b"\xef\xbb\xbfa\xff\r\n\xe2\x82 end")
    with open(os.fsencode(top) + b"/no\xffname.md", "w") as f:
        f.write("its name is no text")
    _write(f"{os.path.dirname(top)}/elsewhere/l.md")
    os.symlink(f"{os.path.dirname(top)}/elsewhere", f"{top}/linked")
    os.symlink(f"{top}/gone", f"{top}/dangling.md")
    return top


def _spark_reads(spark, path):
    reader = notes.note_options(spark.read).text(path, wholetext=True)
    return sorted(map(tuple, notes.note_rows(reader).collect()))


def _files_held(df):
    """Files in the plan of ``df``, each held by the driver."""
    return df.inputFiles()


def test_driver_holds_no_file_and_rows_are_sparks(spark, tmp_dir):
    top = _odd(f"{tmp_dir}/a n")
    paths = [top, [top, f"{top}/a b", f"{top}/_u"], f"{tmp_dir}/a*", [f"{top}/_u/d.md", f"{top}/_metadata.md", f"{top}/bytes.md"], f"{top}/s*b", f"{tmp_dir}/elsewhere"]
    for path in paths:
        got = notes.read_notes(spark, path, hidden="skip")
        assert _files_held(got) == []
        assert sorted(map(tuple, got.collect())) == _spark_reads(spark, path)
        assert notes.count_note_files(spark, path, "skip") == got.count()
    assert notes.read_notes(spark, top, hidden="skip").count() == 15
    with pytest.raises(ValueError, match="notes have names"):
        notes.read_notes(spark, top)
    assert notes.read_notes(spark, f"{tmp_dir}/a*").count() == 15  # patterns are not looked through for hidden names


def test_paths_for_sparks_own_listing(spark, tmp_dir, monkeypatch):
    """An output of a file sink, whose log says which files count, and paths that Arrow does not open."""
    _write(f"{tmp_dir}/n/a.md")
    run_notes_available_now(spark, f"{tmp_dir}/n", f"{tmp_dir}/o", f"{tmp_dir}/c")
    _write(f"{tmp_dir}/o/part-of-a-failed-batch.txt", "not counted")
    assert [r.text for r in notes.read_notes(spark, f"{tmp_dir}/o").collect()] == [r[2] for r in _spark_reads(spark, f"{tmp_dir}/o")]
    assert len(_files_held(notes.read_notes(spark, f"{tmp_dir}/o"))) == 1
    monkeypatch.setattr(note_tree, "_opens", lambda root: False)
    assert len(_files_held(notes.read_notes(spark, f"{tmp_dir}/n"))) == 1
    run_notes_available_now(spark, f"{tmp_dir}/n", f"{tmp_dir}/o2", f"{tmp_dir}/c2")
    assert not os.path.exists(f"{tmp_dir}/c2/listings") and spark.read.text(f"{tmp_dir}/o2").count() == 1
    with pytest.raises(Exception, match="(?i)path does not exist"):
        notes.read_notes(spark, f"{tmp_dir}/absent")


def test_few_tasks_for_many_small_files(spark):
    cores = spark.sparkContext.defaultParallelism
    tasks = note_tree.reading_tasks
    small = tasks(spark, 3_600_000, 9 << 30)
    assert max(note_tree.TASKS_PER_CORE * cores, 72) <= small <= max(note_tree.TASKS_PER_CORE * cores, 1000)
    assert tasks(spark, 1000, 1 << 40) == 1000 and tasks(spark, 10_000, 1 << 40) == 8192  # large ones by their bytes
    assert [tasks(spark, 0, 0), tasks(spark, 1, 10), tasks(spark, 3, 30)] == [1, 1, 3]


def test_links_in_a_circle_end_as_in_sparks_reader(spark, tmp_dir):
    _write(f"{tmp_dir}/n/a.md")
    os.symlink(f"{tmp_dir}/n", f"{tmp_dir}/n/again")
    assert sorted(map(tuple, notes.read_notes(spark, f"{tmp_dir}/n").collect())) == _spark_reads(spark, f"{tmp_dir}/n")
