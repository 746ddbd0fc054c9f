"""Samples -> fine-tuning records.

``SAMPLES`` carries both sample shapes: ``kind`` is ``'conversation'`` (with
``conversations``) or ``'instruction'`` (with ``instruction`` / ``input`` /
``output``). Each format is a projection plus, for Alpaca, a filter; the record
is serialised with ``to_json``, which keeps non-ASCII text unescaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import rules

SAMPLE_COLUMNS = ["sample_id", "source", "kind", "conversations", "instruction", "input", "output"]
CONVERSATION = "conversation"
INSTRUCTION = "instruction"


def conversation_samples(df: DataFrame, sample_id: Column, source: str) -> DataFrame:
    """Rows with a ``conversations`` column -> ``SAMPLES``."""
    return df.select(
        sample_id.cast("string").alias("sample_id"),
        F.lit(source).alias("source"),
        F.lit(CONVERSATION).alias("kind"),
        F.col("conversations"),
        F.lit(None).cast("string").alias("instruction"),
        F.lit(None).cast("string").alias("input"),
        F.lit(None).cast("string").alias("output"),
    )


def instruction_samples(df: DataFrame, sample_id: Column, source: str) -> DataFrame:
    """Rows with ``instruction`` / ``input`` / ``output`` -> ``SAMPLES``."""
    return df.select(
        sample_id.cast("string").alias("sample_id"),
        F.lit(source).alias("source"),
        F.lit(INSTRUCTION).alias("kind"),
        F.lit(None).cast("array<struct<role:string,content:string>>").alias("conversations"),
        "instruction",
        "input",
        "output",
    )


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _is_conversation() -> Column:
    return F.col("kind") == CONVERSATION


def to_sharegpt(samples: DataFrame) -> DataFrame:
    """Conversations pass; an instruction becomes a user turn and an assistant turn (``input`` dropped)."""
    turns = F.when(_is_conversation(), F.col("conversations")).otherwise(
        F.array(_turn("user", F.col("instruction")), _turn("assistant", F.col("output")))
    )
    return samples.select("sample_id", "source", "kind", F.to_json(F.struct(turns.alias("conversations"))).alias("record"))


def to_alpaca(samples: DataFrame) -> DataFrame:
    """P10: instructions pass; a conversation of >= 2 turns becomes turn 0 -> turn 1, roles ignored."""
    conv = _is_conversation()
    kept = samples.where(~conv | (F.size("conversations") >= rules.MIN_TURNS))
    record = F.struct(
        F.when(conv, F.col("conversations")[0]["content"]).otherwise(F.col("instruction")).alias("instruction"),
        F.when(conv, F.lit("")).otherwise(F.col("input")).alias("input"),
        F.when(conv, F.col("conversations")[1]["content"]).otherwise(F.col("output")).alias("output"),
    )
    return kept.select("sample_id", "source", "kind", F.to_json(record).alias("record"))


def to_jsonl(samples: DataFrame) -> DataFrame:
    """Every sample unchanged, in its own shape."""
    record = F.when(_is_conversation(), F.to_json(F.struct("conversations"))).otherwise(
        F.to_json(F.struct("instruction", "input", "output"))
    )
    return samples.select("sample_id", "source", "kind", record.alias("record"))


FORMATTERS = {"sharegpt": to_sharegpt, "alpaca": to_alpaca, "jsonl": to_jsonl}


def format_samples(samples: DataFrame, dataset_format: str) -> DataFrame:
    """Dispatch on the format name; an unknown name is an error, not silently raw JSONL."""
    if dataset_format not in FORMATTERS:
        raise ValueError(f"unknown dataset format {dataset_format!r}; expected one of {sorted(FORMATTERS)}")
    return FORMATTERS[dataset_format](samples)
