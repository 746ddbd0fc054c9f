"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomset
from loomset.session import shared_dir


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once into the cluster's shared folder (reliable checkpoint, survives executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers once, for sessions that were started without it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_loomset_shipped", False):
        return
    top = Path(loomset.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="loomset-ship-"), "loomset.zip")  # read by the driver's own file server
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, str(file.relative_to(top.parent)))
    sc.addPyFile(path)
    sc._loomset_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when the scan has fewer splits than the session has cores (small or badly split files)."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def doc_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the text as UTF-8 bytes (null: empty) as ``data``, and the columns named in ``more``; no others are read."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("data"), *more)


def as_text(data: bytes) -> str:
    """Text of UTF-8 bytes; bytes that are not UTF-8 become U+FFFD instead of an error."""
    return data.decode("utf-8", "replace")


def map_rows(df: DataFrame, schema: str, step: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """``mapInArrow`` over column lists: ``step`` gets a batch as ``{column: list}`` and returns the output columns."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def parts_for(total: float, each: float, least: int = 1) -> int:
    """Number of parts so that each holds about ``each`` of ``total``; it grows with the input and has no ceiling."""
    return max(least, math.ceil(total / each))


def is_held_out(modulus: int, remainder: int, doc_id: str = "doc_id"):
    """Whether crc32 of the id's text leaves the remainder; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus) == F.lit(remainder)
