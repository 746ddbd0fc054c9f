"""The corpus pipeline: documents through quality, near-duplicate, duplicate-passage, privacy and packing stages.

Every stage takes (spark, docs, sf_dir) and gives all rows it keeps; its result is written to the cluster's shared
folder and read again as the next one's documents. All but the last give the columns of ``documents``; where a stage
changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import packing, pii, quality_classifier, simhash, suffix_array
from loomset.llm.common import table
from loomset.llm.queries import vocabulary_path
from loomset.session import scratch_path


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text has it now, where there is such a column."""
    number = F.char_length("text").cast("long")
    return docs.withColumn("n_chars", number) if "n_chars" in docs.columns else docs


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones, does not reject."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def first_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the smallest id."""
    return simhash.keep_first(docs, shingle=simhash.SHINGLE, distance=simhash.DISTANCE)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start in a document with a smaller id."""
    return _counted(suffix_array.strip_repeats(docs))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data under pseudonyms."""
    return _counted(pii.mask(docs, pii.default_key()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, vocabulary_path()).drop("copy")


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", first_of_each_group),
    ("suffix-array dedup", without_repeated_passages),
    ("pii", pseudonymised),
    ("best-fit packing", packed),
]

#: SQL can express neither the trained classifier nor tokenised packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
