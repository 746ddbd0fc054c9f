r"""Large note files, read in pieces by many tasks.

A piece is the lines of one split of the file. Every rule is applied to pieces as to whole texts, which is exact if no
match crosses the line break between two pieces. Of the fixed rules only the phone pattern can match a line break, one
at each of its three separators. A break that it may cross ties its two lines together: the lines at the begin of a
piece that are tied to the piece before are moved there, up to the first break that nothing can cross. Two passes:

1. every piece tells its first and last characters and its first such break; one small row per piece, checkpointed;
2. running sums and looks at the row before, over these rows, tell which lines are moved where.

Limits: a line, and a run of lines that are all tied together, must fit one task. The files are scanned twice and the
text shuffled once in each pass. The splits are fixed when the file is read, as for message logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.session import shared_dir
from loomset.sources.message_log import with_lineage
from loomset.sources.notes import note_options, refuse_hidden

SPLIT_BYTES = 8 << 20
CONTEXT = 32  # characters; a phone number has less on either side of a separator
_PIECE = ["file", "block"]
_MARK = "\ufdd1"  # stands for a line break that a match may cross

# the phone pattern around each of its separators: what stands before it, what behind it
_CODE, _AREA, _SEPARATOR = r"\+?\d{1,3}", r"\(?\d{3}\)?", r"[-.\s]?"
_BEFORE = rf"\b(?:{_CODE}{_SEPARATOR})?{_AREA}"
_SIDES = [
    (rf"\b{_CODE}", rf"{_AREA}{_SEPARATOR}\d{{3}}{_SEPARATOR}\d{{4}}\b"),
    (_BEFORE, rf"\d{{3}}{_SEPARATOR}\d{{4}}\b"),
    (rf"{_BEFORE}{_SEPARATOR}\d{{3}}", r"\d{4}\b"),
]
CROSSED = rules.java_regex("|".join(rf"(?<={before})\n(?={behind})" for before, behind in _SIDES))
MAY_BE_CROSSED = r"(?U)(?<=[\d)])\n(?=[\d(])"  # whatever stands further away
_MAY_END = r"(?U)[\d)]\z"
_MAY_GO_ON = r"(?U)\A[\d(]"


def _marked(text: Column) -> Column:
    return F.regexp_replace(text, CROSSED, _MARK)


def _marked_piece(text: Column) -> Column:
    """Breaks that a match may cross, whatever stands before and behind the piece: near its edges by their two neighbours."""
    edges, between = F.regexp_replace(text, MAY_BE_CROSSED, _MARK), F.length(text) - 2 * CONTEXT
    middle = F.substr(_marked(text), F.lit(CONTEXT + 1), between)
    return F.when(between <= 0, edges).otherwise(F.concat(F.left(edges, F.lit(CONTEXT)), middle, F.right(edges, F.lit(CONTEXT))))


def _tied(last: Column, first: Column) -> Column:
    """A match may cross the break between a text that ends with ``last`` and one that begins with ``first``; texts
    shorter than the context are taken to be tied if their edges allow it."""
    possible = last.rlike(_MAY_END) & first.rlike(_MAY_GO_ON)
    known = (F.length(last) == CONTEXT) & (F.length(first) == CONTEXT)
    at_break = F.substring(_marked(F.concat(last, F.lit("\n"), first)), CONTEXT + 1, 1)
    return F.coalesce(possible & (~known | (at_break == _MARK)), F.lit(False))


def read_pieces(
    spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES, skip_unreadable: bool = True, hidden: str = "error"
) -> DataFrame:
    """``file_path``, ``file_name``, ``block`` (where the piece begins in its file) and ``text`` of every note under ``path``.

    The pieces of a file in the order of ``block``, with a line break between any two, are the text that
    :func:`loomset.sources.notes.read_notes` gives, but for pieces that were moved whole. A file whose pieces do not add
    up to its size was not read to its end and is left out like one that cannot be opened (``skip_unreadable``; the job
    fails without). ``hidden`` is ``"error"`` or ``"skip"``.
    """
    refuse_hidden(spark, path, hidden)
    shared_dir(spark)
    raw = F.col("value")
    lines = with_lineage(
        spark, path, T.clean_utf8(raw).alias("line"), (F.octet_length(raw) + 1).cast("long").alias("bytes"),
        F.col("_metadata.file_size").alias("size"), line_sep="\n", split_bytes=split_bytes,
        prepare=lambda reader: note_options(reader, skip_unreadable),
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("line_id", "line"))), lambda r: r["line"])
    pieces = lines.groupBy(*_PIECE).agg(F.sum("bytes").alias("bytes"), F.min("size").alias("size"), F.array_join(in_order, "\n").alias("text"))

    cut = F.when(F.col("text").rlike(_MAY_GO_ON), F.instr(_marked_piece(F.col("text")), "\n"))  # 0: no such break
    facts = pieces.withColumn("cut", cut).select(
        *_PIECE, "bytes", "size", "cut", F.left("text", F.lit(CONTEXT)).alias("first"), F.right("text", F.lit(CONTEXT)).alias("last"),
        F.when(F.col("cut") > 0, F.substr("text", F.lit(1), F.col("cut") - 1)).when(F.col("cut") == 0, F.col("text")).alias("head"),
    ).checkpoint(eager=True)

    in_file = Window.partitionBy("file").orderBy("block")
    edges = facts.withColumn("tied", _tied(F.lag("last").over(in_file), F.col("first")))
    stays = F.when(~F.col("tied") | (F.col("cut") > 0), F.col("block"))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("owner", F.last(stays, ignorenulls=True).over(before))
    # the last line may have no break behind it; a byte-order mark (3 bytes) is dropped by the line reader, not by read_notes
    edges = edges.withColumn("unread", F.col("size") - F.sum("bytes").over(Window.partitionBy("file")))
    moved = edges.where("tied").groupBy("file", F.col("owner").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "head"))), lambda r: r["head"]), "\n").alias("moved")
    )
    edges = edges.select(*_PIECE, "tied", "cut", "unread").join(moved, _PIECE, "left")

    joined = pieces.drop("bytes", "size").join(edges, _PIECE)
    read = F.col("unread").isin(0, -1, 3, 2)
    joined = joined.where(read if skip_unreadable else F.when(read, True).otherwise(F.raise_error(F.concat(F.lit("not read to its end: "), F.col("file"))).cast("boolean")))
    own = F.when(F.col("tied") & (F.col("cut") > 0), F.substr("text", F.col("cut") + 1)).otherwise(F.col("text"))
    mark = F.when((F.col("block") == 0) & (F.col("unread") >= 2), F.lit("\ufeff")).otherwise(F.lit(""))
    return joined.where(~F.col("tied") | (F.col("cut") > 0)).select(
        F.col("file").alias("file_path"),
        F.url_decode(F.replace(F.substring_index("file", "/", -1), F.lit("+"), F.lit("%2B"))).alias("file_name"),
        "block",
        F.concat_ws("\n", F.concat(mark, own), F.col("moved")).alias("text"),
    )
