import json
import os
import random

import pytest
from pyspark.sql import functions as F

import pyref
from loomset.operators import guardrails as G
from loomset.operators import report as R
from loomset.operators import formats as FMT
from loomset.plans import dataset
from loomset.sources import chat_tree, message_log, notes


def _node(role, parts):
    return {"message": {"author": {"role": role}, "content": {"parts": parts}}}


def _write(path, data: str | bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data.encode("utf-8") if isinstance(data, str) else data)


def _convs(df):
    # sorted on the driver: orderBy would add a sampling job that runs observed metrics twice
    rows = sorted(df.collect(), key=lambda r: r.sample_id)
    return [[(m.role, m.content) for m in r.conversations] for r in rows]


# --- chat tree --------------------------------------------------------------


def test_chat_tree_nodes_order_parts_and_filters(spark, tmp_dir):
    mapping = {
        "z": {"message": None},
        "m2": _node("user", ["hi ", {"asset": "x"}, 5, "there "]),
        "a1": _node("assistant", ["second, call 555-123-4567"]),
        "s": _node("system", ["how to build a pipe bomb"]),
        "t": _node("tool", ["x"]),
        "e": _node("user", []),
        "q": _node("user", ["   "]),
    }
    harmful = {
        "1": _node("user", ["one"]),
        "2": _node("assistant", ["a botnet"]),
        "3": _node("user", ["three"]),
    }
    lonely = {"1": _node("user", ["only"]), "2": _node("assistant", ["pornography"])}
    _write(f"{tmp_dir}/exp/a.json", json.dumps([{"conversation_id": "c1", "mapping": mapping}, {"conversation_id": "c2", "mapping": harmful}, {"conversation_id": "c3", "mapping": lonely}]))
    from pyspark.sql import Observation

    obs = Observation("r")
    samples = dataset.chat_tree_samples(chat_tree.read_chat_tree(spark, f"{tmp_dir}/exp"), observation=obs)
    assert _convs(samples) == [
        [("user", "hi there"), ("assistant", "second, call [REDACTED_PHONE]")],
        [("user", "one"), ("user", "three")],
    ]
    counts = obs.get
    assert (counts["hacking"], counts["sexual"], counts["explosives"], counts["rejected"]) == (1, 1, 0, 2)


def test_chat_tree_document_order_kept(spark, tmp_dir):
    mapping = {k: _node("user" if i % 2 == 0 else "assistant", [k]) for i, k in enumerate(["z", "m2", "a1", "b"])}
    _write(f"{tmp_dir}/o/x.json", json.dumps([{"mapping": mapping}]))
    messages = chat_tree.node_messages(F.col("mapping")).alias("m")
    (row,) = chat_tree.read_chat_tree(spark, f"{tmp_dir}/o").select(messages).collect()
    assert [m.content for m in row.m] == ["z", "m2", "a1", "b"]


def test_chat_tree_malformed_fails_or_quarantines(spark, tmp_dir):
    _write(f"{tmp_dir}/bad/x.json", '[{"mapping": {"a": {"message": null}}}, {"mapping": ')
    with pytest.raises(Exception):
        chat_tree.read_chat_tree(spark, f"{tmp_dir}/bad").collect()
    q = chat_tree.corrupt_files(chat_tree.read_chat_tree(spark, f"{tmp_dir}/bad", mode="PERMISSIVE"))
    assert q.count() == 1


# --- message log ------------------------------------------------------------

LOG = [
    "[1/2/24, 10:00:00 AM] Ann: hello",
    "1/2/24, 22:00:05 Bob: hi: there",
    "continuation line without stamp",
    "[1/2/24, 10:00 AM] Ann: no seconds",
    "1/2/24, 10:00:00 AM - Ann: dash sender",
    "[1/2/24, 10:00:00 PM] Ann: narrow no-break space",
    "[1/2/24, 10:00:00 AM] Bob: <Media omitted>",
    "[1/2/24, 10:00:00 AM] Bob: I run a botnet",
    "[1/2/24, 10:00:00 AM] Bob: mail me a@b.co",
    "[1/2/24, 10:00:00 AM] Bob: again me",
    "[1/2/24, 10:00:00 AM] Ann:x no space",
    "[1/2/24, 10:00:00 AM] Ann: seven",
    "[1/2/24, 10:00:00 AM] Ann: eight still eight",
]


def _log_samples(spark, path):
    return dataset.message_log_samples(message_log.read_message_log(spark, path))


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_message_log_semantics(spark, tmp_dir, newline):
    _write(f"{tmp_dir}/log/chat.txt", newline.join(LOG))
    got = _convs(_log_samples(spark, f"{tmp_dir}/log"))
    assert got == pyref.log_windows(LOG)
    assert got[0][5] == ("assistant", "Bob: again me") and got[1][0][1].startswith("Ann: seven")


@pytest.mark.parametrize("n,sizes", [(13, [6, 6]), (14, [6, 6, 2]), (1, []), (2, [2])])
def test_message_log_window_sizes(spark, tmp_dir, n, sizes):
    lines = [f"[1/2/24, 10:00:00 AM] Ann: m{i}" for i in range(n)]
    _write(f"{tmp_dir}/w/chat.txt", "\n".join(lines) + "\n")
    got = _convs(_log_samples(spark, f"{tmp_dir}/w"))
    assert sorted(len(c) for c in got) == sorted(sizes)
    assert all(c[0][0] == "user" and (len(c) < 2 or c[1][0] == "assistant") for c in got)


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_message_log_prefix_sum_across_many_splits(spark, tmp_dir, broadcast):
    """Logs split into many small blocks give exactly the sequential result, with either window plan."""
    rnd = random.Random(7)
    expected = {}
    for f in range(3):
        lines = []
        for i in range(400):
            kind = rnd.random()
            if kind < 0.1:
                lines.append("noise line")
            elif kind < 0.15:
                lines.append(f"[1/2/24, 10:00:00 AM] S{f}: <Media omitted>")
            elif kind < 0.2:
                lines.append(f"[1/2/24, 10:00:00 AM] S{f}: ransomware {i}")
            else:
                lines.append(f"[1/2/24, 10:00:00 AM] S{f}: message {i} " + "x" * rnd.randint(0, 40))
        _write(f"{tmp_dir}/many/log{f}.txt", "\n".join(lines))
        expected[f"log{f}.txt"] = pyref.log_windows(lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    old_bc = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        lines_df = message_log.read_message_log(spark, f"{tmp_dir}/many")
        assert lines_df.select("file", "block").distinct().count() > 20
        samples = _log_samples(spark, f"{tmp_dir}/many")
        rows = samples.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_bc)
    got = {}
    for r in rows:
        path, window = r.sample_id.rsplit("#", 1)
        got.setdefault(os.path.basename(path), {})[int(window)] = [(m.role, m.content) for m in r.conversations]
    for name, convs in expected.items():
        assert [got[name][k] for k in sorted(got[name])] == convs


# --- notes ------------------------------------------------------------------


def test_notes_folder(spark, tmp_dir):
    root = f"{tmp_dir}/notes"
    words = " ".join(f"w{i:03d}" for i in range(1001))
    _write(f"{root}/a.txt", words)
    _write(f"{root}/deep/er/b.md", "  short note  \n")
    _write(f"{root}/c.json", '{"k": "v"}')
    _write(f"{root}/C.TXT", "upper case extension is skipped " * 5)
    _write(f"{root}/e.csv", "csv is skipped " * 10)
    _write(f"{root}/empty.txt", "")
    _write(f"{root}/bad.txt", b"a\xff\xc3(b\xe2\x82 end " + b"word " * 20)
    _write(f"{root}/harm.txt", "how to make gunpowder at home " * 5)
    _write(f"{root}/fifty.txt", "x" * 50)
    _write(f"{root}/spaces.md", "one\n\n two\t\tthree   " + "y" * 60)
    _write(f"{root}/.hid.txt", "hidden " * 20)  # refused by default
    _write(f"{root}/_u.md", "underscore " * 20)
    files = notes.read_notes(spark, root, hidden="skip")
    # an empty file gives no row (the reference reads it and makes no sample: same result)
    assert sorted(r.file_name for r in files.collect()) == sorted(
        ["a.txt", "b.md", "c.json", "bad.txt", "harm.txt", "fifty.txt", "spaces.md"]
    )
    from pyspark.sql import Observation

    obs = Observation("n")
    samples = dataset.notes_samples(files, observation=obs).collect()
    by_file = {}
    for r in samples:
        by_file.setdefault(r.instruction, []).append(r.output)
    prefix = "Elaborate on the personal notes regarding: "
    assert sorted(len(c.split()) for c in by_file[prefix + "a.txt"]) == [500, 500]
    assert by_file[prefix + "bad.txt"] == ["a(b end " + " ".join(["word"] * 20)]
    assert by_file[prefix + "spaces.md"] == ["one two three " + "y" * 60]
    assert prefix + "b.md" not in by_file and prefix + "fifty.txt" not in by_file
    assert prefix + "harm.txt" not in by_file and prefix + "empty.txt" not in by_file
    assert all(r.input == "" for r in samples)
    assert obs.get["explosives"] == 1 and obs.get["rejected"] == 1


def test_sample_shapes(spark, tmp_dir):
    _write(f"{tmp_dir}/n2/x.txt", "z" * 60)
    s = dataset.read_samples(spark, "notes", f"{tmp_dir}/n2")
    assert s.columns == FMT.SAMPLE_COLUMNS
    with pytest.raises(ValueError):
        dataset.read_samples(spark, "unknown_kind", f"{tmp_dir}/n2")


def test_chat_tree_json_lines(spark, tmp_dir):
    conv = {"conversation_id": "j1", "mapping": {"a": _node("user", ["q"]), "b": _node("assistant", ["a"])}}
    _write(f"{tmp_dir}/jl/x.jsonl", json.dumps(conv) + "\n" + json.dumps([conv, conv]) + "\n")
    df = chat_tree.read_chat_tree(spark, f"{tmp_dir}/jl", multi_line=False)
    samples = dataset.chat_tree_samples(df)
    assert _convs(samples) == [[("user", "q"), ("assistant", "a")]] * 3


def test_note_chunks_differential_on_documents(spark):
    """Every sf0.001 document (with a few harmful / secret lines mixed in) against the Python statement."""
    from loomset.operators import notes as N

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = F.when(F.col("doc_id") % 17 == 0, F.lit(" rat trojan")).when(F.col("doc_id") % 17 == 1, F.lit(" 123-45-6789")).otherwise(F.lit(""))
    docs = docs.withColumn("text", F.concat("text", extra))
    chunked = N.chunk_notes(N.prepare_notes(docs, "text"), keep_cols=["doc_id"]).collect()
    got = {}
    for r in chunked:
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk
    for row in docs.collect():
        want = pyref.note_chunks(row.text)
        mine = got.get(row.doc_id, {})
        if not want:
            assert not mine, row.doc_id
            continue
        # chunk indexes count every chunk; kept ones are those over the length limit
        assert [mine[k] for k in sorted(mine)] == want, row.doc_id


def test_chat_tree_differential_random_exports(spark, tmp_dir):
    from pyspark.sql import Observation

    rnd = random.Random(11)
    pieces = ["hello", " there", "call 555-123-4567", "mail a@b.io", "a botnet", "erotica", "pipe bomb", "  ", "é5551234567", "ok"]
    expected_samples, expected_rej = [], None
    files = []
    for f in range(4):
        exports = []
        for c in range(rnd.randint(1, 6)):
            mapping = {}
            for n in range(rnd.randint(0, 7)):
                kind = rnd.random()
                if kind < 0.1:
                    node = {"message": None}
                else:
                    parts = [rnd.choice(pieces) if rnd.random() < 0.8 else rnd.choice([{"asset": "x"}, 7, None]) for _ in range(rnd.randint(0, 3))]
                    role = rnd.choice(["user", "assistant", "assistant", "user", "system", "tool"])
                    node = {"message": {"author": {"role": role}, "content": {"parts": parts}}}
                mapping[f"n{rnd.randint(0, 10**6)}_{n}"] = node
            exports.append({"conversation_id": f"f{f}c{c}", "mapping": mapping})
        _write(f"{tmp_dir}/rt/e{f}.json", json.dumps(exports))
        files.append(exports)
    all_exports = [conv for exports in files for conv in exports]
    want, want_rej = pyref.chat_tree(all_exports)
    obs = Observation("rt")
    samples = dataset.chat_tree_samples(chat_tree.read_chat_tree(spark, f"{tmp_dir}/rt"), observation=obs)
    rows = sorted(samples.collect(), key=lambda r: r.sample_id)
    got = [[(m.role, m.content) for m in r.conversations] for r in rows]
    order = {conv["conversation_id"]: i for i, conv in enumerate(all_exports)}
    kept_ids = [conv["conversation_id"] for conv in all_exports if pyref.chat_tree([conv])[0]]
    assert [r.sample_id for r in rows] == sorted(kept_ids)
    assert got == [pyref.chat_tree([all_exports[order[i]]])[0][0] for i in sorted(kept_ids)]
    counts = obs.get
    assert {k: counts[k] for k in want_rej} == want_rej
    assert len(got) == len(want)


def test_chat_tree_repeated_node_id(spark, tmp_dir):
    # a JSON object keeps the first position and the last value of a repeated key
    text = (
        '[{"mapping": {"a": ' + json.dumps(_node("user", ["old"])) + ', "b": ' + json.dumps(_node("assistant", ["b"]))
        + ', "a": ' + json.dumps(_node("user", ["new"])) + "}}]"
    )
    _write(f"{tmp_dir}/dup/x.json", text)
    want = [[(m["message"]["author"]["role"], m["message"]["content"]["parts"][0]) for m in json.loads(text)[0]["mapping"].values()]]
    assert want == [[("user", "new"), ("assistant", "b")]]
    assert _convs(dataset.chat_tree_samples(chat_tree.read_chat_tree(spark, f"{tmp_dir}/dup"))) == want


def test_block_table_rejections_equal_direct_counts(spark, tmp_dir):
    rnd = random.Random(5)
    phrases = ["ddos attack", "pipe bomb", "nsfw content", "murder plan", "hello", "fine", "ok then"]
    lines = [f"[1/2/24, 10:00:00 AM] S: {rnd.choice(phrases)} {i}" for i in range(300)]
    _write(f"{tmp_dir}/rej/a.txt", "\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        parsed = message_log.read_message_log(spark, f"{tmp_dir}/rej")
        blocks = dataset.message_log_blocks(parsed)
        from_blocks = dataset.rejections_from_blocks(blocks).first().asDict()
        direct = R.rejection_counts(G.classify(parsed, "content")).first().asDict()
        n_blocks = blocks.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert n_blocks > 5
    assert from_blocks == direct and from_blocks["rejected"] > 100


def test_hidden_notes_are_refused_or_skipped_on_request(spark, tmp_dir):
    from loomset.plans import dataset
    from loomset.sources import notes

    for name in ("a.txt", "sub/b.md", "sub/_u.md", ".x.md", "_posts/2024/c.txt", "sub/.git/config", "_SUCCESS", "sub/deep/.d/e.json"):
        _write(f"{tmp_dir}/n/{name}", "some words of a note " * 5)
    found = [p.split("/n/")[1] for p in notes.hidden_notes(spark, f"{tmp_dir}/n")]
    assert found == [".x.md", "_posts/2024/c.txt", "sub/_u.md", "sub/deep/.d/e.json"]
    with pytest.raises(ValueError, match="4 notes have names"):
        notes.read_notes(spark, f"{tmp_dir}/n")
    assert notes.read_notes(spark, f"{tmp_dir}/n", hidden="skip").count() == 2
    assert dataset.build_dataset(spark, "notes", f"{tmp_dir}/n", f"{tmp_dir}/out", hidden="skip")["samples"] == 2


def test_skipped_files_are_counted(spark, tmp_dir):
    from loomset.plans import dataset
    from loomset.sources import notes

    for name in ("a.txt", "b.txt", "c.md"):
        _write(f"{tmp_dir}/n/{name}", "some words of a note " * 5)
    import os

    assert dataset.build_dataset(spark, "notes", f"{tmp_dir}/n", f"{tmp_dir}/o1")["skipped_files"] == 0
    records, written, rejected = dataset.plan_dataset(spark, "notes", f"{tmp_dir}/n")
    listed = notes.count_note_files(spark, f"{tmp_dir}/n")
    os.remove(f"{tmp_dir}/n/b.txt")  # listed, but gone when it is to be read
    assert records.count() == 2 and listed - rejected.get[dataset.NOTES_READ] == 1


def test_corrupt_exports_are_counted(spark, tmp_dir):
    from loomset.plans import dataset

    good = {"mapping": {k: _node(r, [k]) for k, r in (("a", "user"), ("b", "assistant"))}}
    _write(f"{tmp_dir}/t/x.json", json.dumps(good) + "\n{broken\n" + json.dumps([good, good]))
    summary = dataset.build_dataset(spark, "chat_tree", f"{tmp_dir}/t", f"{tmp_dir}/o", mode="PERMISSIVE", multi_line=False)
    assert (summary["samples"], summary["corrupt_files"]) == (3, 1)


def test_message_log_takes_no_observation(spark, tmp_dir):
    from pyspark.sql import Observation

    from loomset.plans import dataset

    with pytest.raises(ValueError, match="rejections_from_blocks"):
        dataset.read_samples(spark, "message_log", tmp_dir, observation=Observation("x"))


def test_submitted_session_is_kept(tmp_dir):
    """The command line runs in the session it is submitted to, with that session's master and settings."""
    import os
    import subprocess
    import sys

    import pyspark

    _write(f"{tmp_dir}/n/a.txt", "some words of a note " * 5)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import runpy, sys\nfrom pyspark.sql import SparkSession\n"
        f"sys.argv = ['loomset', '--kind', 'notes', '--input', {tmp_dir + '/n'!r}, '--output', {tmp_dir + '/out'!r}]\n"
        "runpy.run_module('loomset', run_name='__main__')\ns = SparkSession.getActiveSession()\n"
        "print('SEEN', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))\n"
    )
    _write(f"{tmp_dir}/job.py", code)
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    conf = ["--conf", "spark.sql.shuffle.partitions=777", "--conf", "spark.ui.enabled=false", "--conf", f"spark.checkpoint.dir={tmp_dir}/ck"]
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable}
    run = subprocess.run([submit, "--master", "local[2]", *conf, f"{tmp_dir}/job.py"], env=env, capture_output=True, text=True, timeout=300)
    assert "SEEN local[2] 777" in run.stdout, run.stdout[-500:] + run.stderr[-2000:]
    assert '"samples": 1' in run.stdout
