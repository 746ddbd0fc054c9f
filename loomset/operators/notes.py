"""Note files -> instruction samples.

A note is one row (one file or one table row); its words are split, grouped
into fixed-size chunks and exploded inside the row, so the whole job is narrow:
no shuffle, every task works on its own notes. Notes larger than a task come as
several rows (:func:`prepare_pieces`, :func:`chunk_pieces`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.operators import guardrails as G
from loomset.operators.conversations import broadcast_if_small
from loomset.session import scratch_path


def prepare_notes(
    df: DataFrame,
    text_col: str = "text",
    sanitize_pii: bool = True,
    enforce_guardrails: bool = True,
    tables: rules.RuleTables = rules.TABLES,
) -> DataFrame:
    """Strip, classify (on the unredacted text) and redact; adds ``body``, ``has_text``, ``harm_category``.

    Emptiness (F7) is decided on the stripped text before redaction
    (``has_text``): every replacement token is non-empty, so the answer is the
    same, and a filter on it does not drag the regex chain below itself.
    """
    stripped = df.withColumn("_stripped", T.strip(F.col(text_col))).withColumn("has_text", F.col("_stripped") != "")
    classified = G.classify(stripped, "_stripped", enforce_guardrails, tables)
    return G.redact_column(classified, "_stripped", sanitize_pii, "body", tables).drop("_stripped")


def chunk_notes(
    prepared: DataFrame, chunk_words: int = rules.DEFAULT_CHUNK_WORDS, keep_cols: list[str] | None = None
) -> DataFrame:
    """Clean notes -> one row per kept chunk: ``keep_cols``, ``chunk_index``, ``chunk``."""
    if chunk_words < 1:
        raise ValueError(f"chunk_words must be a positive number of words, got {chunk_words}")
    keep_cols = keep_cols or []
    # The word array is a column of its own: inlined into the chunking lambda
    # it would be re-split once per chunk.
    clean = G.keep_clean(prepared).where("has_text").withColumn("_words", T.words(F.col("body")))
    chunks = T.chunks(F.col("_words"), chunk_words)
    return (
        clean.select(*keep_cols, F.posexplode(chunks).alias("chunk_index", "chunk"))
        .where(F.length("chunk") > rules.MIN_CHUNK_CHARS)
        .withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
    )


def prepare_pieces(pieces: DataFrame, sanitize_pii: bool = True, enforce_guardrails: bool = True) -> DataFrame:
    """Judged and redacted pieces of notes (:mod:`loomset.sources.split_notes`), written to the shared folder and read
    back: ``file_path``, ``file_name``, ``block``, ``body`` (its words, one space between any two), ``n_words``,
    ``harm_category`` (of the piece).

    The table holds the words of all pieces, harmful ones too, so that the rules run once.
    """
    spark, path = pieces.sparkSession, scratch_path(pieces.sparkSession, "note-pieces")
    prepared = prepare_notes(pieces, "text", sanitize_pii, enforce_guardrails).withColumn("words", T.words(F.col("body")))
    prepared = prepared.select(
        "file_path", "file_name", "block", F.array_join("words", " ").alias("body"), F.size("words").cast("long").alias("n_words"), G.HARM
    )
    prepared.write.parquet(path)
    return spark.read.schema(prepared.schema).parquet(path)


def note_verdicts(prepared_pieces: DataFrame) -> DataFrame:
    """F5 for notes in pieces: ``file_path`` and the first category, in table order, that any piece of the note has."""
    order = F.array(*[F.lit(c) for c in rules.HARM_PATTERNS])
    first = F.min(F.array_position(order, F.col(G.HARM)))
    return prepared_pieces.groupBy("file_path").agg(first.alias("_first")).select("file_path", F.get(order, F.col("_first").cast("int") - 1).alias(G.HARM))


def chunk_pieces(prepared_pieces: DataFrame, chunk_words: int = rules.DEFAULT_CHUNK_WORDS) -> DataFrame:
    """T3 + T4 + F5 + F8 for notes in pieces: ``file_path``, ``file_name``, ``chunk_index``, ``chunk``.

    The number of words before a piece is a running sum over one small row per piece. Chunks that lie within a piece are
    cut where it is; only the words at its two ends are shuffled, to be joined with those of its neighbours (all pieces
    once more, if that table is too large to be broadcast).
    """
    if chunk_words < 1:
        raise ValueError(f"chunk_words must be a positive number of words, got {chunk_words}")
    counts = prepared_pieces.select("file_path", "block", F.col("n_words").alias("_n"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_n > 0")
    counts = counts.join(note_verdicts(prepared_pieces).where(F.col(G.HARM).isNull()).select("file_path"), "file_path")
    placed = prepared_pieces.drop(G.HARM, "n_words").join(broadcast_if_small(counts, "file_path"), ["file_path", "block"])
    placed = placed.withColumn("words", F.split("body", " ")).drop("body")

    size = chunk_words
    begin, end = F.expr(f"greatest(chunk_index * {size} - _off, 0)"), F.expr(f"least((chunk_index + 1) * {size} - _off, _n)")
    cut = placed.withColumn("chunk_index", F.explode(F.expr(f"sequence(_off div {size}, (_off + _n - 1) div {size})")))
    cut = cut.withColumn("_begin", begin).withColumn("_size", end - begin)
    words = F.array_join(F.slice("words", (F.col("_begin") + 1).cast("int"), F.col("_size").cast("int")), " ")
    cut = cut.select("file_path", "file_name", "block", "chunk_index", "_size", words.alias("chunk"))
    inside = cut.where(F.col("_size") == size).select("file_path", "file_name", "chunk_index", "chunk")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "chunk"))), lambda p: p["chunk"])
    joined = cut.where(F.col("_size") < size).groupBy("file_path", "file_name", "chunk_index").agg(F.array_join(parts, " ").alias("chunk"))
    return inside.unionByName(joined).where(F.length("chunk") > rules.MIN_CHUNK_CHARS)


def instruction_samples(chunked: DataFrame, name_col: str = "file_name") -> DataFrame:
    """``instruction`` from the file name, empty ``input``, the chunk as ``output``."""
    return chunked.withColumn("instruction", F.concat(F.lit(rules.NOTE_INSTRUCTION_PREFIX), F.col(name_col))).select(
        "*", F.lit("").alias("input"), F.col("chunk").alias("output")
    )
