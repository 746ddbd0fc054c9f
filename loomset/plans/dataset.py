"""S7 + end to end: pick a source, judge, redact, assemble, format, write, report.

:func:`read_samples` returns the ``SAMPLES`` DataFrame of one source kind;
:func:`build_dataset` formats and writes it and returns the run summary. The
sample count - and, for notes and chat trees, the rejection counts - are
collected with ``observe()`` on the job that writes the dataset, so the input
is scanned once; message-log rejections come from an exact aggregate (see
:func:`build_dataset`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.operators import conversations as C
from loomset.operators import formats as FMT
from loomset.operators import guardrails as G
from loomset.operators import notes as N
from loomset.operators import report as R
from loomset.session import shared_dir
from loomset.sources import chat_tree, jsonl, message_log, note_tree, notes, split_notes

SOURCE_KINDS = ("chat_tree", "message_log", "notes")
NOTES_READ = "notes_read"
SKIPPED_NAMED = 100  # names of unreadable notes in a summary


def _judge_messages(messages, enforce_guardrails: bool, tables: rules.RuleTables):
    verdict = (lambda m: T.harm_category(m["content"], tables=tables)) if enforce_guardrails else (lambda m: F.lit(None).cast("string"))
    return F.transform(
        messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), verdict(m).alias(G.HARM))
    )


def chat_tree_samples(
    exports: DataFrame,
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    observation: Observation | None = None,
    tables: rules.RuleTables = rules.TABLES,
) -> DataFrame:
    """Row-local S1 flow: one row per conversation in, one sample per kept conversation out (no shuffle)."""
    # conversations of one large export are judged by many tasks; a projected id that is not deterministic keeps filters
    # above it, so that verdicts and redactions are worked out once per message
    spread = exports.repartition("file", "conv_key")
    judged = spread.select(
        "file",
        "conversation_id",
        "conv_key",
        _judge_messages(chat_tree.node_messages(F.col("mapping")), enforce_guardrails, tables).alias("msgs"),
        F.monotonically_increasing_id().alias("_judged"),
    )
    if observation is not None:
        judged = judged.observe(observation, *R.array_rejection_exprs(F.col("msgs"), tables.harm))
    redact = (lambda c: T.redact_guarded(c, tables)) if sanitize_pii else (lambda c: c)
    kept = F.transform(
        F.filter("msgs", lambda m: m[G.HARM].isNull()),
        lambda m: F.struct(m["role"].alias("role"), redact(m["content"]).alias("content")),
    )
    convs = judged.select(
        F.coalesce(F.col("conversation_id"), F.concat_ws("#", "file", F.col("conv_key").cast("string"))).alias("sid"),
        kept.alias("conversations"),
        (F.monotonically_increasing_id() + F.col("_judged")).alias("_kept"),
    ).where((F.size("conversations") >= rules.MIN_TURNS) & (F.col("_kept") >= 0))
    return FMT.conversation_samples(convs, F.col("sid"), "chat_tree")


def table_conversation_samples(
    messages: DataFrame,
    key_col: str,
    order_col: str,
    role_col: str = "role",
    text_col: str = "text",
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    observation: Observation | str | None = None,
    block_size: int | None = None,
    tables: rules.RuleTables = rules.TABLES,
) -> DataFrame:
    """Chat messages held as a table (one row per message) -> one sample per conversation.

    Same rules as the chat-tree flow: strip, user/assistant only, judge,
    drop harmful, redact, keep conversations with two or more messages.
    ``block_size`` turns on two-level assembly for giant conversations
    (:func:`loomset.operators.conversations.assemble`).
    """
    msgs = messages.select(key_col, order_col, role_col, T.strip(F.col(text_col)).alias("content"))
    judged = G.classify(C.message_filter(msgs, role_col, "content"), "content", enforce_guardrails, tables)
    if observation is not None:
        judged = judged.observe(observation, *R.rejection_exprs(categories=tables.harm))
    kept = G.redact_column(G.keep_clean(judged), "content", sanitize_pii, tables=tables)
    convs = C.assemble(kept, [key_col], order_col, role_col, "content", block_size=block_size)
    return FMT.conversation_samples(convs, F.col(key_col), "chat_table")


TABLE_LOG_BLOCK = 1 << 16  # lines per ordering block of one log held in a table


def table_log_samples(
    lines: DataFrame,
    file_col: str,
    order_col: str,
    sender_col: str,
    text_col: str,
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    block_size: int = TABLE_LOG_BLOCK,
    tables: rules.RuleTables = rules.TABLES,
) -> DataFrame:
    """Log messages held as a table (one row per line, explicit order) -> six-message windows.

    The text is stripped and must be non-empty and not a media placeholder; the
    rest is the message-log flow. Lines are ordered by the order column (null
    first) and, where it is equal, by a hash of sender and text, so any two
    runs give the same windows; only lines equal in all of these may change
    places. ``block_size`` consecutive order values of a log form one ordering
    block, lines without one a block of their own, so a very long log is
    ordered by many tasks. Where no log has more than ``block_size`` lines (one
    pruned count per log), logs are ordered directly, without the pass that
    counts blocks; the windows are the same either way.
    """
    block = F.coalesce(F.expr(f"{order_col} div {block_size}"), F.lit(-(1 << 63)))
    longest = lines.groupBy(file_col).count().agg(F.max("count")).first()[0] or 0
    msgs = lines.select(
        F.col(file_col).alias("file"),
        block.alias("block"),
        F.struct(F.col(order_col).alias("order"), F.xxhash64(sender_col, text_col).alias("tie")).alias("line_id"),
        F.col(sender_col).alias("sender"),
        T.strip(F.col(text_col)).alias("content"),
    ).where((F.col("content") != "") & ~F.col("content").startswith(rules.MEDIA_PREFIX))
    if longest > block_size:
        return message_log_samples(msgs, sanitize_pii, enforce_guardrails, tables=tables)
    kept = G.redact_column(G.keep_clean(G.classify(msgs, "content", enforce_guardrails, tables)), "content", sanitize_pii, tables=tables)
    return _window_samples(C.short_log_windows(kept, "file", "line_id", "sender", "content"))


def message_log_blocks(lines: DataFrame, enforce_guardrails: bool = True, tables: rules.RuleTables = rules.TABLES) -> DataFrame:
    """Pass 1 for parsed log lines, materialised: per (file, block) the kept count ``_n`` and the rejections.

    One small row per block, checkpointed in the shared folder. It serves both
    the window positions and the exact rejection totals
    (:func:`rejections_from_blocks`), so a run scans its input twice, not three
    times.
    """
    shared_dir(lines.sparkSession)
    judged = G.classify(lines, "content", enforce_guardrails, tables)
    per_block = judged.groupBy("file", "block").agg(
        F.count_if(F.col(G.HARM).isNull()).alias("_n"), *R.rejection_exprs(categories=tables.harm)
    )
    return per_block.checkpoint(eager=True)


def rejections_from_blocks(blocks: DataFrame, tables: rules.RuleTables = rules.TABLES) -> DataFrame:
    """A2/A3 totals from :func:`message_log_blocks` (an ordinary aggregate: exact under retries)."""
    return blocks.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast("bigint").alias(c) for c in [*tables.harm, "rejected"]])


def message_log_samples(
    lines: DataFrame,
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    blocks: DataFrame | None = None,
    tables: rules.RuleTables = rules.TABLES,
) -> DataFrame:
    """S2 flow on parsed lines (``file``, ``block``, ``line_id``, ``sender``, ``content``).

    ``blocks`` is the materialised pass 1 (:func:`message_log_blocks`), which
    also has the exact rejection counts; it is computed here when not given.
    """
    judged = G.classify(lines, "content", enforce_guardrails, tables)
    kept = G.redact_column(G.keep_clean(judged), "content", sanitize_pii, tables=tables)
    if blocks is None:
        blocks = message_log_blocks(lines, enforce_guardrails, tables)
    return _window_samples(C.tumbling_windows(kept, "file", "block", "line_id", "sender", "content", counts=blocks))


def _window_samples(windows: DataFrame) -> DataFrame:
    return FMT.conversation_samples(windows, F.concat_ws("#", "file", F.col("window_index").cast("string")), "message_log")


def notes_samples(
    files: DataFrame,
    chunk_words: int = rules.DEFAULT_CHUNK_WORDS,
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    observation: Observation | str | None = None,
    tables: rules.RuleTables = rules.TABLES,
) -> DataFrame:
    """S3 flow on note rows (``file_path``, ``file_name``, ``text``); batch or streaming.

    ``observation`` may be a name: streaming queries report named metrics in
    their progress instead of an ``Observation``.
    """
    prepared = N.prepare_notes(files, "text", sanitize_pii, enforce_guardrails, tables)
    if observation is not None:
        prepared = prepared.observe(observation, *R.rejection_exprs(categories=tables.harm), F.count(F.lit(1)).alias(NOTES_READ))
    return _chunk_samples(N.chunk_notes(prepared, chunk_words, keep_cols=["file_path", "file_name"]))


def _chunk_samples(chunked: DataFrame) -> DataFrame:
    records = N.instruction_samples(chunked, "file_name")
    return FMT.instruction_samples(
        records, F.concat_ws("#", "file_path", F.col("chunk_index").cast("string")), "notes"
    )


def split_note_pieces(
    spark: SparkSession,
    path: str | list[str],
    split_bytes: int = split_notes.SPLIT_BYTES,
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    hidden: str = "error",
    tables: rules.RuleTables = rules.TABLES,
) -> DataFrame:
    """Judged and redacted pieces of the notes under ``path``, materialised, for notes that are larger than a task.

    Only the fixed rules are known to match within a piece, so rule tables of one's own are refused.
    """
    if tables is not rules.TABLES:
        raise ValueError("notes are read in pieces for the fixed rule tables only")
    return N.prepare_pieces(split_notes.read_pieces(spark, path, split_bytes, hidden=hidden), sanitize_pii, enforce_guardrails)


def split_notes_samples(pieces: DataFrame, chunk_words: int = rules.DEFAULT_CHUNK_WORDS) -> DataFrame:
    """The samples of :func:`notes_samples` from :func:`split_note_pieces`."""
    return _chunk_samples(N.chunk_pieces(pieces, chunk_words))


def rejections_from_pieces(pieces: DataFrame) -> DataFrame:
    """A2/A3 totals and the notes read, from :func:`split_note_pieces` (an ordinary aggregate: exact under retries)."""
    return N.note_verdicts(pieces).agg(*R.rejection_exprs(), F.count(F.lit(1)).alias(NOTES_READ))


def read_samples(
    spark: SparkSession,
    kind: str,
    path: str | list[str],
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    chunk_words: int = rules.DEFAULT_CHUNK_WORDS,
    observation: Observation | None = None,
    mode: str = "FAILFAST",
    multi_line: bool | str = True,
    hidden: str = "error",
    tables: rules.RuleTables = rules.TABLES,
    split_bytes: int | None = None,
) -> DataFrame:
    """``SAMPLES`` of one source kind (``chat_tree`` | ``message_log`` | ``notes``).

    ``mode`` and ``multi_line`` are those of :func:`loomset.sources.chat_tree.read_chat_tree`, ``hidden`` that of
    :func:`loomset.sources.notes.read_notes`. Message logs take no ``observation``: their messages are judged before a
    shuffle, where a repeated task would count twice (:func:`rejections_from_blocks` gives exact counts). With
    ``split_bytes`` notes are read in pieces of that size (:func:`split_note_pieces`), also without an ``observation``.
    """
    if kind == "chat_tree":
        exports = chat_tree.read_chat_tree(spark, path, mode, multi_line)
        return chat_tree_samples(exports, sanitize_pii, enforce_guardrails, observation, tables)
    if kind == "message_log":
        if observation is not None:
            raise ValueError("message logs take no observation; use message_log_blocks and rejections_from_blocks")
        return message_log_samples(message_log.read_message_log(spark, path), sanitize_pii, enforce_guardrails, tables=tables)
    if kind == "notes" and split_bytes is not None:
        if observation is not None:
            raise ValueError("notes in pieces take no observation; use split_note_pieces and rejections_from_pieces")
        pieces = split_note_pieces(spark, path, split_bytes, sanitize_pii, enforce_guardrails, hidden, tables)
        return split_notes_samples(pieces, chunk_words)
    if kind == "notes":
        files = notes.read_notes(spark, path, hidden=hidden)
        return notes_samples(files, chunk_words, sanitize_pii, enforce_guardrails, observation, tables)
    raise ValueError(f"unknown source kind {kind!r}; expected one of {SOURCE_KINDS}")


def plan_dataset(
    spark: SparkSession,
    kind: str,
    path: str | list[str],
    dataset_format: str = "sharegpt",
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    chunk_words: int = rules.DEFAULT_CHUNK_WORDS,
    mode: str = "FAILFAST",
    multi_line: bool | str = True,
    hidden: str = "error",
    tables: rules.RuleTables = rules.TABLES,
    split_bytes: int | None = None,
) -> tuple[DataFrame, Observation, Observation | DataFrame]:
    """The records DataFrame of one run (not executed) with its sample observation and rejection counts.

    The sample count is observed on the writing stage itself. Rejections are
    observed on the same job where the judging also runs in that final stage
    (notes, chat trees: no shuffle), so the input is scanned once. Message
    logs judge before a shuffle, so their rejections are returned as a
    one-row DataFrame summed from the materialised pass-1 block table, which is
    exact under retries. So are those of notes in pieces (``split_bytes``).
    """
    if dataset_format not in FMT.FORMATTERS:
        raise ValueError(f"unknown dataset format {dataset_format!r}; expected one of {sorted(FMT.FORMATTERS)}")
    if kind not in SOURCE_KINDS:
        raise ValueError(f"unknown source kind {kind!r}; expected one of {SOURCE_KINDS}")
    if kind == "message_log":
        lines = message_log.read_message_log(spark, path)
        blocks = message_log_blocks(lines, enforce_guardrails, tables)
        samples = message_log_samples(lines, sanitize_pii, enforce_guardrails, blocks, tables)
        rejected: Observation | DataFrame = rejections_from_blocks(blocks, tables)
    elif kind == "notes" and split_bytes is not None:
        pieces = split_note_pieces(spark, path, split_bytes, sanitize_pii, enforce_guardrails, hidden, tables)
        samples, rejected = split_notes_samples(pieces, chunk_words), rejections_from_pieces(pieces)
    else:
        rejected = Observation("rejections")
        samples = read_samples(spark, kind, path, sanitize_pii, enforce_guardrails, chunk_words, rejected, mode, multi_line, hidden, tables)
    return *plan_records(samples, dataset_format), rejected


def plan_records(samples: DataFrame, dataset_format: str) -> tuple[DataFrame, Observation]:
    """Records of ``samples`` in a format, and the observation that counts them as they are written."""
    written = Observation("samples")
    return FMT.format_samples(samples, dataset_format).observe(written, F.count(F.lit(1)).alias("samples")), written


def write_dataset(
    records: DataFrame, written: Observation, rejected: Observation | DataFrame, output: str, compression: str = "none"
) -> dict:
    """Write planned records as JSONL under ``output``; the sample count and the rejection counts of the run.

    A run without samples leaves an earlier dataset at ``output`` alone (a new path becomes an empty folder): the
    records are written beside it and take its place only if there are any.
    """
    spark = records.sparkSession
    if not jsonl.exists(spark, output):
        jsonl.write_jsonl(records, output, compression=compression)
    else:
        staged = f"{output.rstrip('/')}.staged-{uuid.uuid4().hex[:12]}"
        jsonl.write_jsonl(records, staged, compression=compression)
        jsonl.replace(spark, staged, output, keep_target=written.get["samples"] == 0)
    counts = rejected.get if isinstance(rejected, Observation) else rejected.first().asDict()
    return {"samples": int(written.get["samples"])} | {k: int(v) for k, v in counts.items()}


def _skipped_names(spark: SparkSession, path: str | list[str], hidden: str) -> list[str]:
    """The first ``SKIPPED_NAMED`` notes that cannot be read; all of them: :func:`note_tree.unreadable_notes`."""
    failed = note_tree.unreadable_notes(spark, path, hidden == "read")
    return [row.file_path for row in failed.orderBy("file_path").limit(SKIPPED_NAMED).collect()]


def build_dataset(
    spark: SparkSession,
    kind: str,
    path: str | list[str],
    output: str,
    dataset_format: str = "sharegpt",
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    chunk_words: int = rules.DEFAULT_CHUNK_WORDS,
    compression: str = "none",
    mode: str = "FAILFAST",
    multi_line: bool | str = True,
    hidden: str = "error",
    tables: rules.RuleTables = rules.TABLES,
    split_bytes: int | None = None,
) -> dict:
    """Read, judge, redact, assemble, format and write JSONL under ``output``; return the run summary.

    Besides sample and rejection counts the summary has what was left out: ``skipped_files`` for notes that could not be
    read and ``skipped_names`` for the first hundred of their paths, ``corrupt_files`` for chat-tree exports (or lines) that did not parse in ``PERMISSIVE`` mode.
    """
    records, written, rejected = plan_dataset(
        spark, kind, path, dataset_format, sanitize_pii, enforce_guardrails, chunk_words, mode, multi_line, hidden, tables, split_bytes
    )
    summary = {
        "source": kind,
        "dataset_format": dataset_format,
        "sanitize_pii": sanitize_pii,
        "enforce_guardrails": enforce_guardrails,
        "output": output,
    } | write_dataset(records, written, rejected, output, compression)
    if kind == "notes":
        summary["skipped_files"] = notes.count_note_files(spark, path, hidden) - summary[NOTES_READ]
        summary["skipped_names"] = _skipped_names(spark, path, hidden) if summary["skipped_files"] else []
    if kind == "chat_tree":
        permissive = mode.upper() == "PERMISSIVE"
        exports = chat_tree.read_chat_tree(spark, path, mode, multi_line) if permissive else None
        summary["corrupt_files"] = chat_tree.corrupt_files(exports).count() if permissive else 0
    return summary
