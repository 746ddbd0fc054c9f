"""Table inputs (parquet) with enough scan parallelism for row-local text work.

The text operators are narrow (no shuffle), so a table stored as a few large
row groups would run all its regex work in a few tasks. Planned splits do not
tell: a split without the middle of a row group has no rows. :func:`spread`
therefore counts the rows of the splits, from the footers alone, unless there are
more splits than a few per core and few bytes in each. If fewer splits than the
cores have rows, or the largest has more than ``TASK_BYTES`` of the table, the
rows are hash-distributed on their key, to as many tasks as the table has
``TASK_BYTES``: no task grows with the table. That is lazy and moves
only the columns asked for; a metrics node above it keeps Catalyst from pushing
the regex filters below the exchange, back into the few scan tasks.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS_PER_CORE = 4  # a scan with more planned splits than this is left alone without looking
TASKS_PER_CORE = 2
TASK_BYTES = 32 << 20  # of the stored table, for one task
_numbers = count()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(top).getLength()


def spread(df: DataFrame, key: str, path: str) -> DataFrame:
    """``df``, the table at ``path``, in tasks of bounded size."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        planned = df.rdd.getNumPartitions()
        stored = stored_bytes(df.sparkSession, path)
    except Exception:  # noqa: BLE001 - sessions without RDD access (e.g. Spark Connect): leave as is
        return df
    if planned >= SPLITS_PER_CORE * cores and stored <= planned * TASK_BYTES // 2:
        return df
    splits = df.groupBy(F.spark_partition_id().alias("split")).count()  # reads no column
    filled, rows, most = splits.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if filled >= cores and most * stored <= rows * TASK_BYTES:
        return df
    name = f"spread_{next(_numbers)}"  # metrics of one query need different names
    tasks = max(TASKS_PER_CORE * cores, -(-stored // TASK_BYTES))
    return df.repartition(tasks, key).observe(name, F.count(F.lit(1)).alias("rows"))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``columns`` of ``{sf_dir}/{name}.parquet``, spread on the first when its splits are too few or too large."""
    path = f"{sf_dir}/{name}.parquet"
    return spread(spark.read.parquet(path).select(*columns), columns[0], path)
