"""Incremental notes import with Structured Streaming.

The notes flow (S3 -> guardrails -> redaction -> chunks -> records) is narrow
and stateless, so the batch operators run unchanged on a file stream: each new
note file is read once, turned into records and appended to the JSONL output,
exactly once across restarts thanks to the checkpoint (kept in the shared work
folder unless given). Rejection counts of every micro-batch are reported in
``StreamingQueryProgress.observedMetrics["rejections"]``; Spark keeps the
reports of the last batches only, so :func:`run_notes_available_now` has it
keep those of its whole run.

Spark's file source holds every file it has found, and every file it has ever
seen, on the driver. So :func:`run_notes_available_now` first has tasks list
the notes and write the names of those that are new beside the checkpoint, in
one file for each batch (:func:`list_new_notes`), and streams these listings:
each is read once, and the notes it names are read by tasks. A note is new if
no listing of the checkpoint names it. The stream of
:func:`notes_stream_writer` alone finds new notes at every trigger, by Spark's
source; a checkpoint goes on in the way in which it began.

Message logs are not offered as a stream: their windows depend on the order of
all earlier lines of the same file, which a growing file set does not give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomset.functions import rules
from loomset.operators import formats as FMT
from loomset.plans import dataset
from loomset.session import scratch_path
from loomset.sources import note_tree
from loomset.sources.notes import listed_notes, note_options, note_rows, refuse_hidden

NAMES = "root string, inner string, size long"
MAX_FILES_PER_TRIGGER = 100_000
PROGRESS_KEPT = "spark.sql.streaming.numRecentProgressUpdates"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"  # a batch is listed by a task per file otherwise


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _folder(spark, path)
    return fs.exists(where)


def _listings(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/listings"


def _read_listings(reader, listings: str) -> DataFrame:
    return reader.schema(NAMES).option("recursiveFileLookup", True).parquet(listings)


def _numbered(notes: DataFrame) -> DataFrame:
    """``notes``, which must give the same rows in the same order each time, numbered from 0 in ``number``."""
    spark, task, at = notes.sparkSession, F.spark_partition_id(), F.monotonically_increasing_id()
    rows, before = [], 0
    for task_id, notes_of in sorted(notes.groupBy(task.alias("task")).count().collect()):
        rows.append((task_id, before - (task_id << 33)))  # ids of a task begin at its number in the bits from the 33rd
        before += notes_of
    first = F.broadcast(spark.createDataFrame(rows, "task int, first long"))
    return notes.withColumns({"task": task, "at": at}).join(first, "task").withColumn("number", F.col("at") + F.col("first")).drop("task", "at", "first")


def list_new_notes(
    spark: SparkSession, folder: str, checkpoint: str, max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER, hidden: str = "error"
) -> bool:
    """Have tasks write the names of the notes under ``folder`` that ``checkpoint`` has not listed yet, one file for each
    ``max_files_per_trigger``.

    False where only Spark's own source will do: the checkpoint began with it, or tasks cannot list the notes. Listings of a
    run take their place at once, when all are written; a run that breaks off leaves none or all.
    """
    listings = _listings(checkpoint)
    if _exists(spark, f"{checkpoint.rstrip('/')}/offsets") and not _exists(spark, listings):
        return False
    found = listed_notes(spark, folder, hidden)
    if found is None:
        return False
    where, fs = _folder(spark, listings)
    fs.mkdirs(where)
    path = note_tree.path_column().alias("path")
    seen = _read_listings(spark.read, listings).select(path).hint("merge")  # names are many, however small their files
    new = found.select("root", "inner", "size", path).join(seen, "path", "left_anti").drop("path").checkpoint(eager=True)
    if total := new.count():
        each = max_files_per_trigger or total
        batches = _numbered(new).withColumn("batch", F.expr(f"number div {each}")).drop("number")
        run = uuid.uuid4().hex[:12]
        staged, to = (_folder(spark, f"{listings}/{name}-{run}")[0] for name in ("_staged", "run"))
        by_batch = batches.repartition(-(-total // each), "batch").write.option("maxRecordsPerFile", 0)
        by_batch.partitionBy("batch").parquet(staged.toString())
        if not fs.rename(staged, to):
            raise OSError(f"could not move {staged} to {to}")
    return True


def _largest_batch(spark: SparkSession, checkpoint: str) -> tuple[int, int]:
    """Most notes and most bytes of a listing that the stream has not taken up yet."""
    name = F.substring_index(F.input_file_name(), "/", -3).alias("name")  # run, batch and file
    rows = _read_listings(spark.read, _listings(checkpoint)).groupBy(name).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
    log = f"{checkpoint.rstrip('/')}/sources/0"
    if _exists(spark, log):
        taken = F.substring_index(F.get_json_object("value", "$.path"), "/", -3).alias("name")
        rows = rows.join(spark.read.text(log).select(taken), "name", "left_anti")
    files, size = rows.agg(F.max("files"), F.max("size")).first()
    return files or 0, size or 0


def _listed_rows(spark: SparkSession, checkpoint: str, skip_unreadable: bool) -> DataFrame:
    """The notes listed for ``checkpoint`` as a stream, a listing for each batch."""
    # no listing is too old to be read
    reader = spark.readStream.option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d")
    names = _read_listings(reader, _listings(checkpoint))
    tasks = note_tree.reading_tasks(spark, *_largest_batch(spark, checkpoint))
    return note_tree.note_rows(note_tree.read_names(note_tree.deal_names(names, tasks), skip_unreadable), encoded=True)


def notes_stream_writer(
    spark: SparkSession,
    folder: str,
    output: str,
    dataset_format: str = "sharegpt",
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    chunk_words: int = rules.DEFAULT_CHUNK_WORDS,
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER,
    skip_unreadable: bool = True,
    hidden: str = "error",
    listed: bool = False,
) -> DataStreamWriter:
    """A configured (not started) stream: call ``.trigger(...)`` / ``.start()`` on it.

    ``max_files_per_trigger`` bounds one micro-batch (its file list and plan);
    an available-now run still processes every file, in several batches. With
    ``listed`` the stream reads the notes that :func:`list_new_notes` has listed
    for ``checkpoint``, a listing in each batch, and looks for no others.
    """
    if listed:
        files = _listed_rows(spark, checkpoint, skip_unreadable)
    else:
        refuse_hidden(spark, folder, hidden)
        reader = note_options(spark.readStream.format("text"), skip_unreadable)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        files = note_rows(reader.option("wholetext", True).load(folder))
        if checkpoint and _exists(spark, _listings(checkpoint)):  # Spark's source would read all its notes again
            raise ValueError(f"{checkpoint} has listings of its notes: go on with run_notes_available_now, or begin another")
    samples = dataset.notes_samples(files, chunk_words, sanitize_pii, enforce_guardrails, observation="rejections")
    records = FMT.format_samples(samples, dataset_format).select("record")
    return (
        records.writeStream.format("text")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "notes-stream-checkpoint"))
    )


def run_notes_available_now(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER,
    hidden: str = "error",
    **kwargs,
) -> list[dict]:
    """Process every note file not yet seen, then stop; returns the rejection counts per micro-batch."""
    listing = min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get(LISTING_TASKS)))
    settings = {PROGRESS_KEPT: str((1 << 31) - 1), LISTING_TASKS: str(listing)}
    kept = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        kwargs |= {"max_files_per_trigger": max_files_per_trigger, "hidden": hidden}
        kwargs["listed"] = list_new_notes(spark, folder, checkpoint, max_files_per_trigger, hidden)
        query = notes_stream_writer(spark, folder, output, checkpoint=checkpoint, **kwargs).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    batches = []
    for progress in query.recentProgress:
        row = (progress.observedMetrics or {}).get("rejections")
        if row is not None:
            batches.append({k: int(v) for k, v in row.asDict().items()})
    return batches
