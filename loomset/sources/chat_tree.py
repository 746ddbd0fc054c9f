"""Chat-tree exports (a JSON array of conversations with a node ``mapping``).

One row per conversation. The nodes are handled inside the row with
higher-order functions (P1-P3, F1, F2): no explode and no shuffle, and the
``mapping`` is read as a ``MAP`` so the nodes keep document order (a VARIANT
object would come back in key order). ``parts`` is ``ARRAY<VARIANT>`` so that
non-string parts can be told apart and skipped instead of being stringified.

A multi-line JSON file is parsed by one task, so scale comes from many export
files, or from ``multi_line="split"``, where the elements of one large array are
found and parsed by many tasks (:mod:`loomset.sources.json_array`). A malformed file fails the job by default (``FAILFAST``), or with
``mode="PERMISSIVE"`` lands in :func:`corrupt_files`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.sources import json_array

NODE = "struct<message:struct<author:struct<role:string>,content:struct<parts:array<variant>>>>"
CHAT_TREE_SCHEMA = f"conversation_id string, mapping map<string,{NODE}>, _corrupt_record string"


def read_chat_tree(
    spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", multi_line: bool | str = True
) -> DataFrame:
    """Export file(s) -> ``file``, ``conversation_id``, ``conv_key``, ``mapping`` (+ ``_corrupt_record``).

    ``multi_line=True`` reads the export as written (one JSON document per file,
    parsed whole by one task). ``multi_line=False`` reads JSON lines - one
    conversation, or one array of conversations, per line - which Spark splits
    across tasks. ``multi_line="split"`` gives the rows of ``True`` for exports as
    written, with many tasks for each file; a broken array fails the job in
    either mode, an element that does not parse is judged by ``mode``.
    """
    if multi_line == "split":
        return _from_elements(json_array.read_elements(spark, path), mode)
    reader = (
        spark.read.schema(CHAT_TREE_SCHEMA)
        .option("multiLine", multi_line)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )
    df = reader.json(path)
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        "conversation_id",
        # position-derived key, unique per conversation; only lineage
        F.monotonically_increasing_id().alias("conv_key"),
        "mapping",
        "_corrupt_record",
    )


def _from_elements(elements: DataFrame, mode: str) -> DataFrame:
    options = {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = elements.withColumn("row", F.from_json("text", CHAT_TREE_SCHEMA, options))
    fields = [F.col(f"row.{c}").alias(c) for c in ("mapping", "_corrupt_record")]
    return parsed.select("file", F.col("row.conversation_id").alias("conversation_id"), F.monotonically_increasing_id().alias("conv_key"), *fields)


def corrupt_files(df: DataFrame) -> DataFrame:
    """Quarantine: files that did not parse (PERMISSIVE mode only).

    A corrupt row has every data column NULL; testing ``mapping`` as well keeps
    a data column in every query over the result (Spark rejects a JSON scan
    whose only data column is the corrupt-record column, e.g. under ``count``).
    """
    bad = F.col("_corrupt_record").isNotNull() & F.col("mapping").isNull()
    return df.where(bad).select("file", "_corrupt_record")


def _content(parts: Column) -> Column:
    strings = F.filter(parts, lambda p: F.schema_of_variant(p) == F.lit("STRING"))
    return T.strip(F.array_join(F.transform(strings, lambda p: p.cast("string")), ""))


def document_nodes(mapping: Column) -> Column:
    """Node values in document order, with JSON-object semantics for a repeated node id.

    A ``MAP`` read from JSON keeps every entry; a JSON object keeps one per id,
    at the first position, with the last value. For a map with a repeated id,
    entries sorted by (id, place) give each id's first and last place, and
    these are sorted by the first: as costly as a sort, whatever the number of
    repeats.
    """
    def once(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def places(ordered: Column) -> Column:
        """(first, last) place of every id, by the first."""
        other = lambda x, j: F.get(ordered, j)["k"] != x["k"]
        first = F.filter(ordered, lambda x, j: (j == 0) | other(x, j - 1))
        last = F.filter(ordered, lambda x, j: (j == F.size(ordered) - 1) | other(x, j + 1))
        return F.array_sort(F.zip_with(first, last, lambda f, l: F.struct(f["i"].alias("first"), l["i"].alias("last"))))

    keys = F.map_keys(mapping)
    by_key = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    deduped = once(F.map_values(mapping), lambda values: F.transform(once(by_key, places), lambda p: F.get(values, p["last"])))
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(mapping.isNull(), F.lit(None)).when(unique, F.map_values(mapping)).otherwise(deduped)


def node_messages(mapping: Column) -> Column:
    """P1-P3 + F1 + F2: ``array<struct<role, content>>`` of the kept nodes, in document order."""
    nodes = F.filter(document_nodes(mapping), lambda n: F.size(n["message"]["content"]["parts"]) > 0)
    messages = F.transform(
        nodes,
        lambda n: F.struct(
            n["message"]["author"]["role"].alias("role"), _content(n["message"]["content"]["parts"]).alias("content")
        ),
    )
    return F.filter(messages, lambda m: (m["content"] != F.lit("")) & m["role"].isin(*rules.CHAT_ROLES))

