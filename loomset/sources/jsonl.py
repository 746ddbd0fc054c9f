"""K1: JSON-lines sink - one record per line, UTF-8, overwriting.

The records are written by the executors as a directory of part files; nothing
is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(records: DataFrame, path: str, record_col: str = "record", compression: str = "none") -> None:
    """Write ``record_col`` (a JSON string per row) under ``path``, replacing what was there.

    ``compression`` is any codec of Spark's text writer (``gzip``, ``zstd``, ...);
    readers of JSON lines decompress by file extension.
    """
    records.select(record_col).write.mode("overwrite").option("compression", compression).text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Read a written dataset back as ``record`` strings; the earlier one if a replacement broke off half-way."""
    restore(spark, path)
    return spark.read.text(path).withColumnRenamed("value", "record")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _aside(spark: SparkSession, path: str):
    """Where an earlier dataset stands while its place is given to a new one."""
    where, _ = _folder(spark, path)
    return _folder(spark, f"{where.getParent()}/_replaced-{where.getName()}")[0]


def restore(spark: SparkSession, path: str) -> None:
    """Put an earlier dataset back in its place if a replacement broke off before the new one stood there."""
    where, fs = _folder(spark, path)
    aside = _aside(spark, path)
    if fs.exists(aside) and not fs.exists(where) and not fs.rename(aside, where):
        raise OSError(f"could not move {aside} back to {path}")


def exists(spark: SparkSession, path: str) -> bool:
    restore(spark, path)
    where, fs = _folder(spark, path)
    return fs.exists(where)


def replace(spark: SparkSession, staged: str, target: str, keep_target: bool) -> None:
    """Put the finished folder ``staged`` in the place of ``target``, or drop it (``keep_target``).

    The earlier dataset is moved aside, the new one moved in, and only then is the earlier one deleted. Where that breaks
    off in between, the earlier one is put back: at once if the move failed, else by the next :func:`exists`,
    :func:`read_jsonl` or :func:`replace` of that path.
    """
    new, fs = _folder(spark, staged)
    old, _ = _folder(spark, target)
    if keep_target:
        fs.delete(new, True)
        return
    restore(spark, target)
    aside = _aside(spark, target)
    fs.delete(aside, True)  # left by a run that ended before it could delete it; the target is there
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"could not move {target} aside")
    try:
        moved = fs.rename(new, old)
    finally:
        restore(spark, target)
    if not moved:
        raise OSError(f"could not move {staged} to {target}")
    fs.delete(aside, True)
