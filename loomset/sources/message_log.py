"""Message-log text files, one message per matching line.

The text scan stays splittable: a large log is read by many tasks. Every line
keeps ``file`` plus the start of the split it came from (``block``) and a
``line_id`` taken directly on the scan, before any shuffle; within a split the
id grows with the line order and the split start orders the splits of a file.
Together they give the exact line order the window operators need
(:func:`loomset.operators.conversations.tumbling_windows`). The windows read a
log twice, so the settings that decide the splits are fixed when the log is
read: neither later settings nor a changed number of cores move a split
between the two passes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T

LINE = rules.java_regex(rules.LOG_LINE_PATTERN, dotall=True)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines with lineage: ``file``, ``block``, ``line_id``, ``line`` (invalid UTF-8 dropped)."""
    return with_lineage(spark, path, T.clean_utf8(F.col("value")).alias("line"))


SPLIT_SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


def with_lineage(
    spark: SparkSession,
    path: str | list[str],
    *columns: Column,
    line_sep: str | None = None,
    split_bytes: int | None = None,
    prepare: Callable[[DataFrameReader], DataFrameReader] = lambda reader: reader,
) -> DataFrame:
    """``file``, ``block``, ``line_id`` and ``columns`` of a text scan whose splits are those of this moment; lines end
    at ``line_sep`` if given. Splits have at most ``split_bytes`` if given, ``prepare`` sets further reader options.

    A scan plans its splits with the settings of the session it was read in. That is a session of its own here, with the
    caller's settings spelled out; the frame itself goes on in the caller's session. The id is not deterministic, so no
    predicate moves below this projection and each of ``columns`` is worked out once per line.
    """
    fixed = spark.newSession()
    for name in SPLIT_SETTINGS:
        value = spark.conf.get(name, None)
        if value is None and name.endswith("minPartitionNum"):
            value = str(spark.sparkContext.defaultParallelism)  # what Spark takes when it is unset
        if value is not None:
            fixed.conf.set(name, value)
    if split_bytes is not None:
        fixed.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    scan = prepare(fixed.read).text(path, lineSep=line_sep).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        *columns,
    )
    name = f"loomset_{uuid.uuid4().hex}"
    scan.createGlobalTempView(name)  # views of this kind are how one session hands a frame to another
    out = spark.table(f"global_temp.{name}")
    spark.catalog.dropGlobalTempView(name)
    return out


def _sender_and_content(line: Column) -> tuple[Column, Column]:
    """The two groups of the log pattern; both empty where the line does not match (a match may have empty groups)."""
    return F.regexp_extract(line, LINE, 2).alias("sender"), F.regexp_extract(line, LINE, 3).alias("content")


def _is_message() -> Column:
    """F3 + F4: a line that does not match has empty content, as has an empty message."""
    return (F.col("content") != "") & ~F.col("content").startswith(rules.MEDIA_PREFIX)


def parse_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """F3 + P5 + F4: keep lines of the log pattern; add ``sender`` and ``content``; drop empty/media lines."""
    parsed = lines.select(*[c for c in lines.columns if c != line_col], *_sender_and_content(T.strip(F.col(line_col))))
    return parsed.where(_is_message())


def read_message_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``block``, ``line_id``, ``sender``, ``content`` of every message line."""
    line = T.strip(T.clean_utf8(F.col("value")))
    return with_lineage(spark, path, *_sender_and_content(line)).where(_is_message())
