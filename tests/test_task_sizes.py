"""Note files, listings and words whose cost stays small at size, and tasks that do not grow with their table."""

import os
import re
import time
from urllib.parse import unquote

from loomset.functions import rules
from loomset.functions import text as T
from loomset.sources import notes, render, tables
from loomset.streaming import notes_stream
from pyspark.sql import functions as F


def test_notes_are_written_by_tasks_and_keep_every_row(spark, tmp_dir):
    """Equal, empty and null texts, bytes that are no UTF-8, and languages that are no plain folder names."""
    rows = [("en", "same"), ("en", "same"), ("en", None), (None, "nolang"), ("", "empty"), ("a/b=c%", "odd"), ("x y", "")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    broken = docs.where("lang = 'en' AND text = 'same'").withColumn("text", F.concat(F.unhex(F.lit("C3")).cast("string"), "text"))
    path = render.render_notes(docs.unionAll(broken), f"{tmp_dir}/n")
    found = []
    for folder, _, names in os.walk(path):
        for name in names:
            assert re.fullmatch(r"part-\d+-[0-9a-f]{40}-\d+\.txt", name)  # by content: written again, it is the same file
            with open(f"{folder}/{name}", "rb") as f:
                found.append((unquote(os.path.basename(folder)[5:]), f.read()))
    default = "__HIVE_DEFAULT_PARTITION__"
    want = [(lang or default, (text or "").encode() + b"\n") for lang, text in rows] + [("en", b"\xc3same\n")] * 4
    assert sorted(found) == sorted(want)
    plain = render._write_text(docs.select("lang", F.col("text").alias("value")), f"{tmp_dir}/p", ["lang"], maxRecordsPerFile=1)
    assert {d for d in os.listdir(path)} == {d for d in os.listdir(plain) if d.startswith("lang=")}


def test_hidden_names_are_looked_for_in_few_calls(spark, tmp_dir):
    """The search asks nothing of single notes."""
    os.makedirs(f"{tmp_dir}/n/a/b/.c")
    for k in range(3000):
        open(f"{tmp_dir}/n/a/b/{k}.txt", "w").close()
    for name in ("a/_x.md", "a/b/.c/d.json", "a/b/.y.txt", "a/b/.z.csv"):
        open(f"{tmp_dir}/n/{name}", "w").close()
    began = time.time()
    found = [p.split("/n/")[1] for p in notes.hidden_notes(spark, f"{tmp_dir}/n")]
    assert found == ["a/_x.md", "a/b/.c/d.json", "a/b/.y.txt"] and time.time() - began < 30


def test_stream_lists_its_batches_in_few_tasks(spark, tmp_dir):
    old = spark.conf.get(notes_stream.LISTING_TASKS)
    seen, start = [], notes_stream.notes_stream_writer
    spark.conf.set(notes_stream.LISTING_TASKS, "10000")
    try:
        notes_stream.notes_stream_writer = lambda session, *a, **k: seen.append(session.conf.get(notes_stream.LISTING_TASKS)) or start(session, *a, **k)
        render.render_notes(spark.createDataFrame([("en", "word " * 60)], "lang string, text string"), f"{tmp_dir}/n")
        notes_stream.run_notes_available_now(spark, f"{tmp_dir}/n", f"{tmp_dir}/o", f"{tmp_dir}/c")
        assert seen == [str(4 * spark.sparkContext.defaultParallelism)] and spark.conf.get(notes_stream.LISTING_TASKS) == "10000"
    finally:
        notes_stream.notes_stream_writer = start
        spark.conf.set(notes_stream.LISTING_TASKS, old)


def test_words_split_at_a_literal_space(spark):
    texts = ["", "a", "a b", "a  b\n\tc\r\n d", "x".join(rules.WHITESPACE_CHARS).strip(), "\u200bno\u180espace", "\u65e5\u672c\u3000\u8a9e\xa0e", "\U0001f600 \u2028 b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r.w for r in df.select(T.words(F.col("t")).alias("w")).collect()] == [*(t.split() for t in texts), None]
    plan = df.select(T.words(F.col("t")))._jdf.queryExecution().toString()
    assert "split(" in plan and "+, -1)" not in plan


def test_phones_are_found_as_before(spark):
    import random

    deal = random.Random(5)
    texts = ["".join(deal.choice("0123456789--..(()+ a\u0663_\n") for _ in range(60)) for _ in range(3000)] + ["+1 (555) 123-4567", "a+15551234567", "(555)123-4567", " (555) 1234567x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(T.redact_step("phone", F.col("t")).alias("p")).collect()]
    want = [re.sub(rules.PII_PATTERNS["phone"], rules.PII_REPLACEMENTS["phone"], t) for t in texts]
    assert got == want and sum(g != t for g, t in zip(got, texts)) > 20
    assert rules.java_regex(rules.PII_PATTERNS["phone"]).startswith(r"(?U)(?=[+(\d])")


def test_tasks_do_not_grow_with_the_table(spark, tmp_dir, monkeypatch):
    """As many splits with rows as cores, each larger than a task should be."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(4000).repartition(cores).selectExpr("id", "sha2(string(id), 512) s").write.parquet(f"{tmp_dir}/t.parquet")
    size = tables.stored_bytes(spark, f"{tmp_dir}/t.parquet")
    monkeypatch.setattr(tables, "TASK_BYTES", size // (6 * cores))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a split per file
    try:
        rows = [r["count"] for r in tables.read_table(spark, tmp_dir, "t", "id", "s").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert sum(rows) == 4000 and len(rows) >= 6 * cores and max(rows) < 4000 / cores / 2
