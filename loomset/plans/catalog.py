"""Registered queries over the provided tables (one per operator of the inventory).

Each query takes ``(spark, sf_dir)``, reads whole tables (``documents``,
``conversations``) and returns a DataFrame with flat, scalar columns so that it
can be compared with the DuckDB statement of the same name in
:mod:`loomset.plans.oracle`. Conversations come out as their JSON text
(``to_json``), which is also what the sink writes.

The provided corpus contains no harmful phrase, SSN or API key, so
:func:`documents_with_hits` / :func:`conversations_with_hits` append a few,
chosen by id, to make the guardrail and redaction paths observable. Every row
is still processed; the same rule is written in SQL in the oracle.

Queries that read files (``*_scan``, ``jsonl_sink``, ``samples_end_to_end``)
first render the tables in that file format under the shared work folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.operators import conversations as C
from loomset.operators import formats as FMT
from loomset.operators import guardrails as G
from loomset.operators import notes as N
from loomset.operators import report as R
from loomset.plans import dataset
from loomset.session import scratch_path
from loomset.sources import chat_tree, jsonl, message_log, notes, render
from loomset.sources.tables import read_table
from loomset.streaming.notes_stream import run_notes_available_now

# Injected test hits: (modulus, remainder, appended text).
DOC_HITS_97 = [
    (0, " ransomware"),
    (1, " pipe bomb"),
    (2, " erotica"),
    (3, " murder plan"),
    (4, " a botnet and how to kill"),
    (5, " keyloggers"),
]
DOC_HITS_89 = [(0, " 123-45-6789"), (1, " sk-" + "abcdefghijklmnopqrstuvwx")]
# conversations: (conv_id % 23, turn, appended text)
CONV_HITS_23 = [(0, 1, " ransomware"), (1, 0, " pipe bomb"), (2, 1, " erotica"), (3, 2, " murder plan"), (4, 0, " 123-45-6789")]

# doc_id % 1997: few enough that most notes of many documents are kept
NOTE_HITS_1997 = [(500, " a botnet and how to kill"), (501, " pipe bomb"), (1300, " murder plan"), (1301, " erotica")]
NOTE_PIECE = 1 << 17  # the notes of notes_split are small; so are their pieces

# a user's own rules, on texts as the provided corpus has them
OWN_TABLES = rules.RuleTables(
    harm={"shouting": [r"[a-z]+!!\s[a-z]+!!"], "markup": ["###|%%%", r"\*\*\*\s[a-z]"], "wording": [r"of\s(?:the|and)\sthe"]},
    pii={"shout": "[a-zA-Z]+!!", "number": r"\d{4}", "of_the": r"of\sthe"},
    replacements={"shout": "[SHOUT]", "number": "[NUMBER]", "of_the": "[OF THE]"},
)


def _case(key: Column, cases: list[tuple[int, str]]) -> Column:
    out = F.lit("")
    for rem, txt in reversed(cases):
        out = F.when(key == rem, F.lit(txt)).otherwise(out)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "lang", "text")


def documents_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    text = F.concat(F.col("text"), _case(F.col("doc_id") % 97, DOC_HITS_97), _case(F.col("doc_id") % 89, DOC_HITS_89))
    return d.select("doc_id", "lang", text.alias("text"))


def conversations_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = F.lit("")
    for rem, turn, txt in reversed(CONV_HITS_23):
        extra = F.when((F.col("conv_id") % 23 == rem) & (F.col("turn") == turn), F.lit(txt)).otherwise(extra)
    return c.select("conv_id", "turn", "role", F.concat(F.col("text"), extra).alias("text"))


def _note_name(doc_id: Column) -> Column:
    return F.concat(F.lit("doc_"), doc_id.cast("string"), F.lit(".txt"))


# --- notes / documents ------------------------------------------------------


def q_harm_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_with_hits(spark, sf_dir)
    return d.select("doc_id", T.harm_category(T.strip(F.col("text"))).alias("harm_category"))


def q_harm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_with_hits(spark, sf_dir).withColumn("text", T.strip(F.col("text")))
    return G.keep_clean(G.classify(d, "text")).select("doc_id", "text")


def q_pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_with_hits(spark, sf_dir).select("doc_id", T.strip(F.col("text")).alias("stripped"))
    return G.redact_column(d, "stripped", out_col="redacted").select("doc_id", "redacted")


def q_own_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 and T2 by rule tables given as arguments."""
    d = documents_with_hits(spark, sf_dir).select("doc_id", T.strip(F.col("text")).alias("stripped"))
    judged = G.classify(d, "stripped", tables=OWN_TABLES)
    return G.redact_column(judged, "stripped", out_col="redacted", tables=OWN_TABLES).select("doc_id", "harm_category", "redacted")


def _chunks(spark: SparkSession, sf_dir: str, sanitize_pii: bool = True, enforce_guardrails: bool = True) -> DataFrame:
    prepared = N.prepare_notes(documents_with_hits(spark, sf_dir), "text", sanitize_pii, enforce_guardrails)
    return N.chunk_notes(prepared, rules.DEFAULT_CHUNK_WORDS, keep_cols=["doc_id"])


def q_note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


def q_guardrails_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, enforce_guardrails=False)


def q_redaction_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, sanitize_pii=False)


def _instructions(chunked: DataFrame) -> DataFrame:
    return N.instruction_samples(chunked.withColumn("file_name", _note_name(F.col("doc_id"))), "file_name")


def q_notes_to_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instructions(_chunks(spark, sf_dir)).select("doc_id", "chunk_index", "instruction", "input", "output")


def q_rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = N.prepare_notes(documents_with_hits(spark, sf_dir), "text")
    return R.rejection_counts(prepared)


def _notes_run(spark: SparkSession, sf_dir: str, dataset_format: str) -> dict:
    """The notes job over table rows as notes, written and counted as ``build_dataset`` does it."""
    rows = documents_with_hits(spark, sf_dir)
    files = rows.select(F.col("doc_id").cast("string").alias("file_path"), _note_name(F.col("doc_id")).alias("file_name"), "text")
    rejected = Observation("rejections")
    records, written = dataset.plan_records(dataset.notes_samples(files, observation=rejected), dataset_format)
    out = scratch_path(spark, "notes-out")
    return dataset.write_dataset(records, written, rejected, out) | {"output": out}


def _summary_row(spark: SparkSession, run: dict, dataset_format: str) -> DataFrame:
    counts = spark.createDataFrame([tuple(run[c] for c in [*R.CATEGORIES, "rejected"])], ", ".join(f"{c} long" for c in [*R.CATEGORIES, "rejected"]))
    return R.run_summary(counts, run["samples"], dataset_format, True, True)


def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + A5: the summary of the notes job."""
    return _summary_row(spark, _notes_run(spark, sf_dir, "sharegpt"), "sharegpt")


def q_pipeline_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 to K1 for every source kind: the run's summary, and the records read back from what it wrote."""
    convs = conversations_with_hits(spark, sf_dir)
    runs = []
    for kind, dataset_format in (("chat_tree", "alpaca"), ("message_log", "sharegpt"), ("notes", "jsonl")):
        if kind == "notes":
            run = _notes_run(spark, sf_dir, dataset_format)
        else:
            render_files = render.render_chat_tree if kind == "chat_tree" else render.render_message_logs
            source = render_files(convs, scratch_path(spark, f"e2e-{kind}"))
            run = dataset.build_dataset(spark, kind, source, scratch_path(spark, f"e2e-{kind}-out"), dataset_format)
        records, characters = jsonl.read_jsonl(spark, run["output"]).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("record")), F.lit(0))).first()
        row = _summary_row(spark, run, dataset_format)
        runs.append(row.select(F.lit(kind).alias("source"), "*", F.lit(records).cast("long").alias("records"), F.lit(characters).cast("long").alias("characters")))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


# --- conversations ----------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations_with_hits(spark, sf_dir)
    return c.select("conv_id", "turn", "role", T.strip(F.col("text")).alias("content"))


def q_message_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.message_filter(_messages(spark, sf_dir))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = dataset.table_conversation_samples(conversations_with_hits(spark, sf_dir), "conv_id", "turn")
    return samples.select(
        F.col("sample_id").cast("bigint").alias("conv_id"),
        F.size("conversations").cast("bigint").alias("n_messages"),
        "conversations",
    )


def _as_json(df: DataFrame) -> DataFrame:
    return df.withColumn("conversations", F.to_json(F.col("conversations"))).withColumnRenamed(
        "conversations", "conversations_json"
    )


def q_conversation_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(_assembled(spark, sf_dir))


def q_message_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one log (``conv_id`` = file, ``role`` = sender, ``turn`` = line order)."""
    samples = dataset.table_log_samples(conversations_with_hits(spark, sf_dir), "conv_id", "turn", "role", "text")
    return samples.select(
        F.regexp_extract("sample_id", r"^(\d+)#", 1).cast("bigint").alias("conv_id"),
        F.regexp_extract("sample_id", r"#(\d+)$", 1).cast("bigint").alias("window_index"),
        F.size("conversations").cast("bigint").alias("n_messages"),
        F.to_json(F.col("conversations")).alias("conversations_json"),
    )


# --- formats ----------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = _instructions(_chunks(spark, sf_dir))
    notes_part = FMT.instruction_samples(
        inst, F.concat(F.col("file_name"), F.lit("#"), F.col("chunk_index").cast("string")), "notes"
    )
    conv = _assembled(spark, sf_dir)
    conv_part = FMT.conversation_samples(conv, F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), "chat")
    return notes_part.unionByName(conv_part)


def q_format_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FMT.to_sharegpt(_samples(spark, sf_dir)).select("sample_id", "record")


def q_format_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FMT.to_alpaca(_samples(spark, sf_dir)).select("sample_id", "record")


def q_format_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FMT.to_jsonl(_samples(spark, sf_dir)).select("sample_id", "record")


def q_alpaca_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of up to three messages as Alpaca records; those of one message have none."""
    parts = _messages(spark, sf_dir).groupBy("conv_id", F.expr("turn div 3").alias("part"))
    listed = parts.agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("msgs"))
    convs = listed.withColumn("conversations", F.transform("msgs", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    samples = FMT.conversation_samples(convs, F.concat_ws("#", F.col("conv_id").cast("string"), F.col("part").cast("string")), "chat")
    return FMT.to_alpaca(samples).select("sample_id", "record")


# --- sources and sink (render -> read back) ---------------------------------


def q_chat_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = render.render_chat_tree(conversations_with_hits(spark, sf_dir), scratch_path(spark, "chat-tree"))
    samples = dataset.chat_tree_samples(chat_tree.read_chat_tree(spark, path))
    return samples.select(
        F.col("sample_id").cast("bigint").alias("conv_id"),
        F.size("conversations").cast("bigint").alias("n_messages"),
        F.to_json(F.col("conversations")).alias("conversations_json"),
    )


def q_chat_tree_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = render.render_chat_tree(conversations_with_hits(spark, sf_dir), scratch_path(spark, "chat-tree-split"), convs_per_file=1 << 16)
    samples = dataset.chat_tree_samples(chat_tree.read_chat_tree(spark, path, multi_line="split"))
    return samples.select(
        F.col("sample_id").cast("bigint").alias("conv_id"),
        F.size("conversations").cast("bigint").alias("n_messages"),
        F.to_json(F.col("conversations")).alias("conversations_json"),
    )


def q_message_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = render.render_message_logs(conversations_with_hits(spark, sf_dir), scratch_path(spark, "message-log"))
    lines = message_log.read_message_log(spark, path)
    return lines.select(F.regexp_extract("file", r"log=(\d+)", 1).cast("bigint").alias("log"), "sender", "content")


def q_notes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = render.render_notes(documents_with_hits(spark, sf_dir), scratch_path(spark, "notes"))
    files = notes.read_notes(spark, path)
    return files.select(F.regexp_extract("file_path", r"lang=([^/]+)", 1).alias("lang"), T.strip(F.col("text")).alias("text"))


def q_notes_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of every name, half of them in a hidden folder and with bytes that are not UTF-8; tables beside them
    are no notes."""
    docs, path = documents_with_hits(spark, sf_dir), scratch_path(spark, "note-tree")
    odd = F.col("doc_id") % 2 == 1
    broken = F.concat(F.unhex(F.lit("C3")).cast("string"), F.col("text"), F.unhex(F.lit("FF")).cast("string"))
    render.render_notes(docs.where(~odd), f"{path}/notes")
    render.render_notes(docs.where(odd).withColumn("text", broken), f"{path}/_drafts/old")
    docs.write.csv(f"{path}/tables")
    files = notes.read_notes(spark, path, hidden="read")
    return files.select(
        F.regexp_extract("file_path", r"lang=([^/]+)", 1).alias("lang"),
        F.col("file_path").contains("/_drafts/").alias("draft"),
        T.strip(F.col("text")).alias("text"),
    )


def q_notes_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T4, F5, F8 on notes read in pieces: verdicts of whole notes, chunks over the edges of pieces."""
    d = documents(spark, sf_dir)
    text = F.concat("text", _case(F.col("doc_id") % 1997, NOTE_HITS_1997), _case(F.col("doc_id") % 89, DOC_HITS_89))
    path = render.render_joined_notes(d.select("doc_id", text.alias("text")), scratch_path(spark, "notes-split"))
    chunks = N.chunk_pieces(dataset.split_note_pieces(spark, path, split_bytes=NOTE_PIECE))
    return chunks.select(F.regexp_extract("file_path", r"note=(\d+)", 1).cast("bigint").alias("note"), "chunk_index", "chunk")


def q_jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "jsonl")
    jsonl.write_jsonl(FMT.to_sharegpt(_samples(spark, sf_dir)), out)
    return jsonl.read_jsonl(spark, out)


def q_samples_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message logs rendered from the table -> S7 -> windows -> ShareGPT -> JSONL -> read back."""
    logs = render.render_message_logs(conversations_with_hits(spark, sf_dir), scratch_path(spark, "e2e-logs"))
    out = scratch_path(spark, "e2e-out")
    dataset.build_dataset(spark, "message_log", logs, out, "sharegpt")
    return jsonl.read_jsonl(spark, out)


def q_notes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes rendered from ``documents`` -> Structured Streaming (available-now) -> JSONL -> the chunks."""
    src = render.render_notes(documents_with_hits(spark, sf_dir), scratch_path(spark, "stream-notes"))
    out = scratch_path(spark, "stream-out")
    run_notes_available_now(spark, src, out, scratch_path(spark, "stream-checkpoint"), dataset_format="alpaca")
    records = jsonl.read_jsonl(spark, out)
    return records.select(F.get_json_object("record", "$.output").alias("chunk"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "harm_category": q_harm_category,
    "harm_filter": q_harm_filter,
    "pii_redact": q_pii_redact,
    "own_tables": q_own_tables,
    "note_chunks": q_note_chunks,
    "notes_to_instruction": q_notes_to_instruction,
    "guardrails_off": q_guardrails_off,
    "redaction_off": q_redaction_off,
    "rejection_counts": q_rejection_counts,
    "run_summary": q_run_summary,
    "message_filter": q_message_filter,
    "conversation_assemble": q_conversation_assemble,
    "message_log_windows": q_message_log_windows,
    "format_sharegpt": q_format_sharegpt,
    "format_alpaca": q_format_alpaca,
    "format_jsonl": q_format_jsonl,
    "alpaca_turns": q_alpaca_turns,
    "chat_tree_scan": q_chat_tree_scan,
    "chat_tree_split": q_chat_tree_split,
    "message_log_scan": q_message_log_scan,
    "notes_scan": q_notes_scan,
    "notes_tree": q_notes_tree,
    "notes_split": q_notes_split,
    "jsonl_sink": q_jsonl_sink,
    "samples_end_to_end": q_samples_end_to_end,
    "notes_stream": q_notes_stream,
    "pipeline_e2e": q_pipeline_e2e,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> guardrails -> redaction -> 500-word chunks -> instruction records (narrow, no shuffle)."""
    prepared = N.prepare_notes(documents(spark, sf_dir), "text")
    chunked = N.chunk_notes(prepared, rules.DEFAULT_CHUNK_WORDS, keep_cols=["doc_id"])
    return _instructions(chunked).select("doc_id", "chunk_index", "instruction", "input", "output")
