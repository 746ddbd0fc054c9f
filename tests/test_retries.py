"""A failed and retried task must not change the output or the observed counts.

Runs in a subprocess: it needs its own ``local[4,3]`` master (task retries on).
A test-only Python UDF fails the first attempt of every task of the job.
"""

import json
import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(
    """
    import json, os, sys
    sys.path.insert(0, {root!r})
    from pyspark import TaskContext
    from pyspark.sql import Observation, SparkSession, functions as F, types as T
    from loomset.plans import dataset
    from loomset.sources import notes, jsonl

    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    src = {src!r}
    for i in range(12):
        os.makedirs(src, exist_ok=True)
        with open(os.path.join(src, f"n{{i}}.txt"), "w") as f:
            f.write(("botnet " if i % 4 == 0 else "") + "word " * 30)

    marks = {marks!r}
    os.makedirs(marks, exist_ok=True)

    @F.udf(T.BooleanType())
    def first_attempt_fails(x):
        tc = TaskContext.get()
        if tc.attemptNumber() == 0:
            open(os.path.join(marks, f"failed-{{tc.stageId()}}-{{tc.partitionId()}}"), "w").close()
            raise RuntimeError("injected task failure")
        return True

    files = notes.read_notes(spark, src).where(first_attempt_fails(F.col("file_name")))
    obs, written = Observation("r"), Observation("w")
    samples = dataset.notes_samples(files, observation=obs)
    records = samples.select("sample_id").observe(written, F.count(F.lit(1)).alias("n"))
    out = {out!r}
    records.write.mode("overwrite").parquet(out)
    print(json.dumps({{"rows": spark.read.parquet(out).count(), "written": written.get["n"],
                       "hacking": obs.get["hacking"], "rejected": obs.get["rejected"]}}))
    """
)


def test_counts_exact_under_task_retries(tmp_path):
    marks = tmp_path / "marks"
    script = SCRIPT.format(root=ROOT, src=str(tmp_path / "in"), out=str(tmp_path / "out"), marks=str(marks))
    proc = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600)
    assert proc.returncode == 0, proc.stderr[-2000:]
    result = json.loads(proc.stdout.strip().splitlines()[-1])
    assert result == {"rows": 9, "written": 9, "hacking": 3, "rejected": 3}, result
    assert len(os.listdir(marks)) >= 1  # the failures did happen


LOG_SCRIPT = textwrap.dedent(
    """
    import json, os, sys
    sys.path.insert(0, {root!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F, types as T
    from loomset.plans import dataset
    from loomset.sources import message_log

    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").config("spark.sql.files.maxPartitionBytes", "512")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    src = {src!r}
    os.makedirs(src, exist_ok=True)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("\\n".join(f"[1/2/24, 10:00:00 AM] P{{i % 3}}: " + ("ransomware" if i % 10 == 3 else f"m{{i}}") for i in range(100)))

    @F.udf(T.BooleanType())
    def first_attempt_fails(x):
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        return True

    lines = message_log.read_message_log(spark, src).where(first_attempt_fails(F.col("sender")))
    windows = dataset.message_log_samples(lines).collect()
    counts = dataset.rejections_from_blocks(dataset.message_log_blocks(lines)).first()
    sizes = sorted(len(r.conversations) for r in windows)
    first = [m.content for m in sorted(windows, key=lambda r: int(r.sample_id.rsplit("#", 1)[1]))[0].conversations]
    print(json.dumps({{"sizes": sizes, "first": first, "hacking": counts["hacking"], "blocks": lines.select("block").distinct().count()}}))
    """
)


def test_log_windows_exact_under_task_retries(tmp_path):
    script = LOG_SCRIPT.format(root=ROOT, src=str(tmp_path / "logs"))
    proc = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600)
    assert proc.returncode == 0, proc.stderr[-2000:]
    result = json.loads(proc.stdout.strip().splitlines()[-1])
    assert result["blocks"] > 3  # several splits, so the prefix sum is exercised
    assert result["hacking"] == 10
    assert result["sizes"] == [6] * 15  # 90 kept messages
    assert result["first"] == ["P0: m0", "P1: m1", "P2: m2", "P1: m4", "P2: m5", "P0: m6"]
