"""Messages -> conversations: role filter, ordered assembly, tumbling windows.

Two ways to turn ordered messages into conversation samples:

* :func:`assemble` - one sample per conversation key (chat messages). A
  sample is one output row by definition, so the group is collected with
  ``collect_list`` (partial aggregation map-side, then one shuffle on the key)
  and ordered with ``array_sort``; ``block_size`` spreads the sorting of giant
  conversations over many tasks.
* :func:`tumbling_windows` - consecutive runs of ``size`` kept messages of one
  log (message logs). The position of a message inside its log is a prefix
  sum over blocks (splits): a materialised per-block count table, broadcast
  with integer ids when its measured size allows (:func:`_windows_by_ids`),
  else joined co-partitioned (:func:`ordinal_index`). A single huge log is
  spread over many tasks instead of one ``Window.partitionBy(file)`` task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.session import shared_dir

def message_filter(df: DataFrame, role_col: str = "role", content_col: str = "content") -> DataFrame:
    """non-empty content from a user or assistant; everything else never reaches the guardrails."""
    return df.where((F.col(content_col) != "") & F.col(role_col).isin(*rules.CHAT_ROLES))


def _messages(items: Column) -> Column:
    return F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def assemble(
    df: DataFrame,
    key_cols: list[str],
    order_col: str,
    role_col: str = "role",
    content_col: str = "content",
    min_turns: int = rules.MIN_TURNS,
    block_size: int | None = None,
) -> DataFrame:
    """A1 + F6: ``key_cols``, ``n_messages``, ``conversations`` in ``order_col`` order, >= ``min_turns``.

    ``collect_list`` carries the order key inside the struct and ``array_sort``
    restores the order after the shuffle (``collect_list`` alone has none).

    With ``block_size`` (for inputs with giant conversations) the messages are
    first collected and sorted per (key, ``order div block_size``) - spread
    over many tasks - and the final step only concatenates the sorted runs in
    block order. The finished record is still one row, as the format requires;
    for ordinary conversations the extra shuffle is not worth it, hence opt-in.
    """
    item = F.struct(F.col(order_col).alias("o"), F.col(role_col).alias("role"), F.col(content_col).alias("content"))
    if block_size:
        runs = df.groupBy(*key_cols, F.expr(f"{order_col} div {block_size}").alias("_b")).agg(
            F.array_sort(F.collect_list(item)).alias("_run")
        )
        ordered_runs = F.array_sort(F.collect_list(F.struct("_b", "_run")))["_run"]
        grouped = runs.groupBy(*key_cols).agg(F.flatten(ordered_runs).alias("_items"))
    else:
        grouped = df.groupBy(*key_cols).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return grouped.select(
        *key_cols,
        F.size("_items").cast("bigint").alias("n_messages"),
        _messages(F.col("_items")).alias("conversations"),
    ).where(F.col("n_messages") >= min_turns)


def block_counts(df: DataFrame, file_col: str, block_col: str) -> DataFrame:
    """Pass 1 of the prefix sum: kept rows per (file, block), one small row per block.

    Catalyst prunes this branch to the columns that decide whether a row is
    kept (no payload work such as redaction) and aggregates map-side.
    """
    return df.groupBy(file_col, block_col).agg(F.count(F.lit(1)).alias("_n"))


def _offsets(counts: DataFrame, file_col: str, block_col: str) -> DataFrame:
    before = Window.partitionBy(file_col).orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        file_col,
        block_col,
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(file_col)).alias("_total"),
    )


def ordinal_index(
    df: DataFrame, file_col: str, block_col: str, order_col: str, out_col: str = "i", counts: DataFrame | None = None
) -> DataFrame:
    """Exact 0-based position of every row inside its file, ordered by (block, order).

    Prefix-sum form: rows are shuffled once on (file, block) - never on file
    alone - kept rows are counted per block (:func:`block_counts`, or the
    ``counts`` given), an exclusive running sum over that small table gives
    each block's offset, and the offset plus the row number inside the block is
    the position (two passes, like ``zipWithIndex``). The offset table is
    joined back on (file, block): a broadcast only when the planner's estimate
    or AQE's measurement says it is small, otherwise a join co-partitioned with
    the rows (only the offset table is re-shuffled).
    Adds ``out_col`` plus ``_off`` / ``_n`` (first position and row count of the
    block) and ``_total`` (rows of the file).
    """
    keyed = df.repartition(file_col, block_col)
    offsets = _offsets(counts if counts is not None else block_counts(df, file_col, block_col), file_col, block_col)
    joined = keyed.join(offsets, [file_col, block_col], "left")
    return joined.withColumn(out_col, _position([file_col, block_col], order_col))


def _position(block: list[str], order_col: str) -> Column:
    """Position of a row in its file from its block's offset; an error unless the block has exactly the counted rows.

    The counts come from an earlier pass over the same input. If the two passes saw different rows (a file that
    changed, splits that moved), the job fails instead of losing messages.
    """
    place = F.row_number().over(Window.partitionBy(*block).orderBy(order_col))
    rows = F.count(F.lit(1)).over(Window.partitionBy(*block))
    differ = F.col("_n").isNull() | (rows != F.col("_n"))
    error = F.raise_error(F.lit("message log changed between its two passes: a block's rows differ from its count"))
    return F.when(differ, error.cast("bigint")).otherwise((place - 1 + F.col("_off")).cast("bigint"))


def _assemble_windows(
    indexed: DataFrame, file_key: str, block_key: str, sender_col: str, content_col: str, size: int, min_turns: int
) -> DataFrame:
    """Windows from rows carrying ``_i`` / ``_off`` / ``_n`` / ``_total`` and partitioned on (file, block)."""
    window = F.expr(f"_i div {size}")
    first = window * size
    last = F.least(first + (size - 1), F.col("_total") - 1)
    in_block = (first >= F.col("_off")) & (last < F.col("_off") + F.col("_n"))
    rows = indexed.select(
        file_key,
        block_key,
        window.cast("bigint").alias("window_index"),
        in_block.alias("_in_block"),
        F.struct(
            F.col("_i").alias("o"),
            F.when(F.col("_i") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
            F.concat(F.col(sender_col), F.lit(": "), F.col(content_col)).alias("content"),
        ).alias("_item"),
    )
    local = (
        rows.where("_in_block")
        .groupBy(file_key, block_key, "window_index")
        .agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        .drop(block_key)
    )
    straddling = (
        rows.where(~F.col("_in_block"))
        .groupBy(file_key, "window_index")
        .agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    )
    return (
        local.unionByName(straddling)
        .select(
            file_key,
            "window_index",
            F.size("_items").cast("bigint").alias("n_messages"),
            _messages(F.col("_items")).alias("conversations"),
        )
        .where(F.col("n_messages") >= min_turns)
    )


def short_log_windows(
    df: DataFrame,
    file_col: str,
    order_col: str,
    sender_col: str,
    content_col: str,
    size: int = rules.LOG_WINDOW,
    min_turns: int = rules.MIN_TURNS,
) -> DataFrame:
    """:func:`tumbling_windows` for logs of bounded length: a log is ordered by one task, in one pass and one shuffle.

    The caller knows that no log is longer than what one task may order.
    """
    place = F.row_number().over(Window.partitionBy(file_col).orderBy(order_col)) - 1
    item = F.struct(
        F.col("_i").alias("o"),
        F.when(F.col("_i") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.concat(F.col(sender_col), F.lit(": "), F.col(content_col)).alias("content"),
    )
    rows = df.withColumn("_i", place.cast("bigint"))
    rows = rows.select(file_col, F.expr(f"_i div {size}").cast("bigint").alias("window_index"), item.alias("_item"))
    windows = rows.groupBy(file_col, "window_index").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    return windows.select(
        file_col, "window_index", F.size("_items").cast("bigint").alias("n_messages"), _messages(F.col("_items")).alias("conversations")
    ).where(F.col("n_messages") >= min_turns)


_BYTE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}


def broadcast_limit(spark) -> int:
    """The session's ``spark.sql.autoBroadcastJoinThreshold`` in bytes (-1: never broadcast)."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    number = raw.rstrip("bkmgtp")
    return int(float(number) * _BYTE_UNITS[raw[len(number):]]) if number not in ("", "-") else -1


def broadcast_if_small(small: DataFrame, *text_cols: str) -> DataFrame:
    """``small`` to be broadcast if its measured size fits the session's threshold, else as it is."""
    chars = [F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in text_cols]
    rows, *lengths = small.agg(F.count(F.lit(1)), *chars).first()
    # hashed relation overhead included
    return F.broadcast(small) if 2 * (rows * 64 + sum(lengths)) <= broadcast_limit(small.sparkSession) else small


def _windows_by_ids(
    df: DataFrame, counts: DataFrame, file_col: str, block_col: str, order_col: str,
    sender_col: str, content_col: str, size: int, min_turns: int,
) -> DataFrame:
    """Broadcast plan: the (measured, small) block table gives every block and file an integer id.

    The join runs map-side before the shuffle, so the rows travel with two
    integers instead of their file path; the paths are joined back onto the
    finished windows. Ids are exact: ``row_number`` / ``dense_rank`` over the
    block table (one task; it has one row per block).
    """
    ids = _offsets(counts, file_col, block_col).select(
        "*",
        F.row_number().over(Window.orderBy(file_col, block_col)).alias("_bid"),
        F.dense_rank().over(Window.orderBy(file_col)).alias("_fid"),
    )
    rows = df.join(F.broadcast(ids), [file_col, block_col], "left").drop(file_col, block_col)
    indexed = rows.repartition("_bid").withColumn("_i", _position(["_bid"], order_col))
    windows = _assemble_windows(indexed, "_fid", "_bid", sender_col, content_col, size, min_turns)
    files = ids.select("_fid", file_col).distinct()
    return windows.join(F.broadcast(files), "_fid").select(file_col, "window_index", "n_messages", "conversations")


def tumbling_windows(
    df: DataFrame,
    file_col: str,
    block_col: str,
    order_col: str,
    sender_col: str,
    content_col: str,
    size: int = rules.LOG_WINDOW,
    min_turns: int = rules.MIN_TURNS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """W1-W4 + P6: ``file_col``, ``window_index``, ``n_messages``, ``conversations``.

    Kept message ``i`` of a file gets role user/assistant by ``i % 2`` and
    content ``"{sender}: {content}"``; windows are ``i div size``; the last,
    partial window is kept with ``min_turns`` or more messages.

    Pass 1 (:func:`block_counts`, or ``counts`` already materialised by the
    caller with at least ``file_col``, ``block_col``, ``_n``) is materialised
    once with a reliable checkpoint and its size measured. If the block table fits the session's
    broadcast threshold it is broadcast and the rows are shuffled with integer
    ids (:func:`_windows_by_ids`); otherwise the rows are shuffled on
    (file, block) and joined with a co-partitioned offset table
    (:func:`ordinal_index`). Either way, a window whose messages all lie in one
    block is assembled where the rows already are, and only the few windows
    that straddle a block boundary are shuffled again, on (file, window_index).
    """
    if counts is None:
        shared_dir(df.sparkSession)
        counts = block_counts(df, file_col, block_col).checkpoint(eager=True)
    counts = counts.select(file_col, block_col, "_n")
    measured = counts.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(F.col(file_col).cast("string"))), F.lit(0)).alias("chars")
    ).first()
    estimated_bytes = 2 * (measured["rows"] * 64 + measured["chars"])  # hashed relation overhead included
    limit = broadcast_limit(df.sparkSession)
    if 0 <= estimated_bytes <= limit:
        return _windows_by_ids(df, counts, file_col, block_col, order_col, sender_col, content_col, size, min_turns)
    indexed = ordinal_index(df, file_col, block_col, order_col, "_i", counts=counts)
    return _assemble_windows(indexed, file_col, block_col, sender_col, content_col, size, min_turns)
