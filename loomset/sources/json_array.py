r"""Large JSON arrays of objects, cut into their elements by many tasks.

The file is read as text whose records end at ``}``, which Spark's text scan splits like lines. What a record's braces
mean depends on what comes before it, but only in two numbers: whether a string is open, and how deep the braces are. A
record adds to both in a way that can be worked out for either case beforehand, because no escape crosses its end (a
backslash before ``}`` is no JSON). So the state at any place is a sum over what stands before it:

1. every split's quotes, and its change of depth if it begins outside and if it begins inside a string, are summed into
   one small row per split, and running sums over these rows give the state in which each split begins;
2. with that, a running sum inside the split tells the records at whose end the depth is 0 again: the ends of elements.
   They are counted per split, and running sums give every split the number of elements before it;
3. the records of an element, which may lie in several splits, are put together by its number.

A task holds one split's records for sorting and one element for joining; nothing is broadcast unless Spark measures it
as small. The splits are fixed when the file is read, as for message logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.session import shared_dir
from loomset.sources.message_log import with_lineage

_SPLIT = ["file", "block"]


def _braces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))).cast("long")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _shape(record: Column) -> Column:
    """(quotes, even, odd): quotes that are not escaped; opening braces between them in even and in odd places."""

    def counted(parts: Column) -> Column:
        even = F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), "")
        odd = F.array_join(F.filter(parts, lambda _, i: i % 2 == 1), "")
        return F.struct((F.size(parts) - 1).cast("long").alias("quotes"), _braces(even).alias("even"), _braces(odd).alias("odd"))

    return _let(F.split(F.regexp_replace(record, r"(?s)\\.", ""), '"', -1), counted)


def _depth(inside: Column) -> Column:
    """What a record adds to the depth, its end included, where ``inside`` tells whether it begins in a string."""
    ends_inside = (inside.cast("long") + F.col("quotes")) % 2 == 1
    return F.when(inside, F.col("odd")).otherwise(F.col("even")) - F.when(ends_inside, 0).otherwise(1)


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``element`` (0 for the first of its file) and ``text``: the objects of the JSON arrays under ``path``.

    A file that ends before its closing bracket, or has anything but one comma between elements, fails the job, as does
    an element that is no object. An empty file has no elements.
    """
    shared_dir(spark)
    # bytes that are no UTF-8 stay what the JSON reader makes of them: replacement characters
    records = with_lineage(spark, path, F.make_valid_utf8(F.col("value")).alias("record"), line_sep="}")
    rows = records.withColumn("shape", _shape(F.col("record"))).select(*_SPLIT, "line_id", "record", "shape.*")
    in_split = Window.partitionBy(*_SPLIT).orderBy("line_id")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    odd_before = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1

    relative = rows.drop("record").withColumn("odd_before", odd_before)
    changes = relative.select(*_SPLIT, "quotes", _depth(F.col("odd_before")).alias("outside"), _depth(~F.col("odd_before")).alias("within"))
    splits = changes.groupBy(*_SPLIT).agg(*(F.sum(c).alias(c) for c in ("quotes", "outside", "within"))).checkpoint(eager=True)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.withColumn("starts_inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    begins = begins.withColumn("change", F.when(F.col("starts_inside"), F.col("within")).otherwise(F.col("outside")))
    begins = begins.select(*_SPLIT, "starts_inside", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("starts_at"))

    placed = rows.repartition(*_SPLIT).join(begins, _SPLIT).withColumn("inside", F.col("starts_inside") != odd_before)
    placed = placed.withColumn("depth", F.col("starts_at") + F.sum(_depth(F.col("inside"))).over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
    closes = (F.col("inside").cast("long") + F.col("quotes")) % 2 == 0
    placed = placed.withColumn("ends", ((F.col("depth") == 0) & closes).cast("long"))
    counts = placed.groupBy(*_SPLIT).agg(F.sum("ends").alias("ends"), F.max_by("depth", "line_id").alias("depth"), F.max_by(closes, "line_id").alias("closes"))
    counts = counts.checkpoint(eager=True)
    numbers = counts.select(*_SPLIT, F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("first"))
    counted = placed.select(*_SPLIT, "line_id", "record", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("before"))
    numbered = counted.join(numbers, _SPLIT).select("file", (F.col("first") + F.col("before")).alias("element"), F.struct("block", "line_id", "record").alias("r"))

    # the last record of a file has no brace behind it, so an array ends at depth -1
    total = counts.groupBy("file").agg(F.sum("ends").alias("elements"), F.max_by(F.struct("depth", "closes"), "block").alias("last"))
    total = total.select("file", "elements", (F.col("last.closes") & (F.col("last.depth") == -1)).alias("whole"))
    joined = numbered.groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["record"]), "}").alias("text"))
    joined = joined.join(total, "file")
    space = r"[ \t\r\n]*"
    opening = F.when(F.col("element") == 0, F.lit(rf"\A\x{{feff}}?{space}\[{space}(?=\{{)")).otherwise(F.lit(rf"\A{space},{space}(?=\{{)"))
    is_rest = F.col("element") == F.col("elements")
    closing = F.when(F.col("elements") == 0, F.lit(rf"\A\x{{feff}}?{space}\[{space}\]{space}\z")).otherwise(F.lit(rf"\A{space}\]{space}\z"))
    rest = F.regexp_like(F.col("text"), closing)
    fine = F.col("whole") & F.when(is_rest, rest).otherwise(F.regexp_like(F.col("text"), opening))
    failed = F.raise_error(F.concat(F.lit("no JSON array of objects: "), F.col("file"))).cast("string")
    body = F.concat(F.regexp_replace(F.col("text"), opening, F.lit("")), F.lit("}"))
    checked = joined.select("file", "element", "elements", F.when(fine, body).otherwise(failed).alias("text"))
    # the check of what stands behind the last element is read too, as the filter needs the text
    return checked.where((F.col("element") < F.col("elements")) | F.col("text").isNull()).select("file", "element", "text")
