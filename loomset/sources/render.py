"""Render the provided tables as source files (chat-tree JSON, message logs, note folders).

The scan queries and tests read files, while the inputs are parquet tables, so
these jobs write the tables out in each source format - with Spark writers,
single notes by tasks of their own, into a fresh folder under the shared work
folder - to be read back by the sources. The renders reproduce what the sources
must undo:

* chat tree: node ids that are not in turn order, a root node without a
  message, and non-string ``parts`` on every third message;
* message log: two stamp styles, line breaks inside a message turned into
  spaces (continuation lines are not part of a message);
* notes: one file per document, below one folder per language, or one file for
  a run of documents.

A conversation is one JSON object by the format; export and log files group a
bounded number of conversations.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_STAMPS = ("[1/2/24, 10:00:00 AM] ", "1/2/24, 22:00:05 ")
LOG_CONVS_PER_FILE = 16


def _write_text(df: DataFrame, path: str, partition_cols: list[str], **options) -> str:
    writer = df.write.mode("overwrite").option("compression", "none")
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.partitionBy(*partition_cols).text(path)
    return path


def render_chat_tree(conversations: DataFrame, path: str, convs_per_file: int = 64) -> str:
    """``conv_id, turn, role, text`` -> JSON-array export files, ``convs_per_file`` conversations each."""
    node_id = F.substring(F.sha1(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 12)
    text_part = F.to_json(F.array(F.col("text")))
    parts = F.when(
        F.col("turn") % 3 == 2,
        F.concat(F.expr("substring(to_json(array(text)), 1, length(to_json(array(text))) - 1)"), F.lit(', {"asset_pointer": "file-0"}, 7]')),
    ).otherwise(text_part)
    node = F.concat(
        F.lit('"'), node_id, F.lit('": {"message": {"author": '), F.to_json(F.struct("role")),
        F.lit(', "content": {"content_type": "text", "parts": '), parts, F.lit("}}}"),
    )
    per_conv = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", node.alias("node")))).alias("nodes")
    )
    conv_json = F.concat(
        F.lit('{"conversation_id": "'), F.col("conv_id").cast("string"),
        F.lit('", "mapping": {"root": {"message": null}, '), F.array_join(F.col("nodes")["node"], ", "), F.lit("}}"),
    )
    files = (
        per_conv.select((F.col("conv_id") / convs_per_file).cast("bigint").alias("export"), "conv_id", conv_json.alias("j"))
        .groupBy("export")
        .agg(F.array_sort(F.collect_list(F.struct("conv_id", "j"))).alias("convs"))
        .select("export", F.concat(F.lit("[\n"), F.array_join(F.col("convs")["j"], ",\n"), F.lit("\n]")).alias("value"))
    )
    return _write_text(files, path, ["export"])


def log_line(turn: F.Column, sender: F.Column, text: F.Column) -> F.Column:
    """One log line; line breaks inside the text become spaces."""
    stamp = F.when(turn % 2 == 0, F.lit(LOG_STAMPS[0])).otherwise(F.lit(LOG_STAMPS[1]))
    return F.concat(stamp, sender, F.lit(": "), F.regexp_replace(text, r"[\r\n]+", " "))


def log_file_key(conv_id: F.Column, convs_per_file: int = LOG_CONVS_PER_FILE) -> F.Column:
    return (conv_id / convs_per_file).cast("bigint")  # ids are small and non-negative: exact


def render_message_logs(conversations: DataFrame, path: str, convs_per_file: int = LOG_CONVS_PER_FILE) -> str:
    """``conv_id, turn, role, text`` -> log files of ``convs_per_file`` conversations in (conv_id, turn) order.

    Layout ``log=<conv_id div convs_per_file>/part-*.txt``, one file per folder.
    """
    lines = conversations.select(
        log_file_key(F.col("conv_id"), convs_per_file).alias("log"),
        "conv_id",
        "turn",
        log_line(F.col("turn"), F.col("role"), F.col("text")).alias("value"),
    )
    ordered = lines.repartition("log").sortWithinPartitions("log", "conv_id", "turn").select("log", "value")
    return _write_text(ordered, path, ["log"])


def _arrow_root(spark: SparkSession, path: str) -> str | None:
    """``path``, made an empty folder, as an address that Arrow's file systems open; None if they cannot."""
    import pyarrow as pa
    from pyarrow.fs import FileSystem

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(folder).toString()
    root = "file://" + root[5:] if root.startswith("file:/") and not root.startswith("file://") else root
    try:
        FileSystem.from_uri(quote(root, safe="/:@"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    fs.delete(folder, True)
    fs.mkdirs(folder)
    return root


def _note_writer(root: str):
    """Rows -> one file each. A closure, so that workers need not have this package.

    A file is named by its task and its content, and moved to its name when it is whole: a task that runs again writes the
    same files, whatever the order of its rows.
    """

    def write(batches):
        import re
        from collections import Counter
        from hashlib import sha1
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, top = FileSystem.from_uri(quote(root, safe="/:@"))
        task, folders, seen = TaskContext.get(), set(), Counter()
        for batch in batches:
            for lang, content in zip(batch["lang"].to_pylist(), batch["value"].to_pylist()):
                # names of folders as Spark's writers give them
                lang = re.sub("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]", lambda c: f"%{ord(c[0]):02X}", lang) if lang else "__HIVE_DEFAULT_PARTITION__"
                folder, content = f"{top.rstrip('/')}/lang={lang}", (content or b"") + b"\n"
                if folder not in folders:
                    fs.create_dir(folder)
                    folders.add(folder)
                key = sha1(content).digest()
                name = f"{folder}/part-{task.partitionId():05d}-{key.hex()}-{seen[lang, key]}.txt"
                seen[lang, key] += 1
                with fs.open_output_stream(part := f"{name}.{task.taskAttemptId()}", compression=None) as out:
                    out.write(content)
                fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"notes": [sum(seen.values())]}, schema=pa.schema([("notes", pa.int64())]))

    return write


def render_notes(documents: DataFrame, path: str) -> str:
    """``lang, text`` -> one note file per document, ``lang=<l>/part-*.txt``.

    Spark's writer takes some milliseconds for each file and then moves all of them on the driver, so tasks write them
    through Arrow's file systems; where these cannot open the path, the writer does it (``maxRecordsPerFile`` = 1).
    """
    root = _arrow_root(documents.sparkSession, path)
    if root is None:
        return _write_text(documents.select("lang", F.col("text").alias("value")), path, ["lang"], maxRecordsPerFile=1)
    rows = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("value"))
    rows.mapInArrow(_note_writer(root), "notes long").agg(F.sum("notes")).collect()
    return path


DOCS_PER_NOTE = 256


def render_joined_notes(documents: DataFrame, path: str, docs_per_note: int = DOCS_PER_NOTE) -> str:
    """``doc_id, text`` -> one note file per ``docs_per_note`` documents, in ``doc_id`` order, ``note=<n>/part-*.txt``."""
    lines = documents.select(log_file_key(F.col("doc_id"), docs_per_note).alias("note"), "doc_id", F.col("text").alias("value"))
    ordered = lines.repartition("note").sortWithinPartitions("note", "doc_id").select("note", "value")
    return _write_text(ordered, path, ["note"])
