"""Rejection counts and the run summary (A2-A5).

Counts are plain global aggregates (partial per task, one tiny final merge),
zero-filled by construction because every category is its own ``count_if``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.operators.guardrails import HARM

CATEGORIES = list(rules.HARM_PATTERNS)


def rejection_exprs(verdict: Column | None = None, categories: Iterable[str] = CATEGORIES) -> list[Column]:
    """A2 + A3 as aggregate expressions over a verdict column (one row per judged unit)."""
    verdict = F.col(HARM) if verdict is None else verdict
    per_category = [F.count_if(verdict == F.lit(c)).alias(c) for c in categories]
    return [*per_category, F.count(verdict).alias("rejected")]


def rejection_counts(verdicts: DataFrame) -> DataFrame:
    """One row: ``hacking``, ``explosives``, ``sexual``, ``harm``, ``rejected``."""
    return verdicts.agg(*rejection_exprs())


def _is(category: str):
    # one-argument lambda: F.filter treats a two-argument one as (element, index)
    return lambda m: m[HARM] == F.lit(category)


def array_rejection_exprs(messages: Column, categories: Iterable[str] = CATEGORIES) -> list[Column]:
    """A2 + A3 when the verdicts live inside an array column (row-local chat trees)."""
    per_category = [
        F.coalesce(F.sum(F.size(F.filter(messages, _is(c)))), F.lit(0)).cast("bigint").alias(c) for c in categories
    ]
    total = F.coalesce(F.sum(F.size(F.filter(messages, lambda m: m[HARM].isNotNull()))), F.lit(0)).cast("bigint")
    return [*per_category, total.alias("rejected")]


def run_summary(
    counts: DataFrame, samples: Column | int, dataset_format: str, sanitize_pii: bool, enforce_guardrails: bool
) -> DataFrame:
    """A4 + A5: one row with the sample count, the rejections, the format and the toggles."""
    n = samples if isinstance(samples, Column) else F.lit(samples)
    return counts.select(
        F.lit(dataset_format).alias("dataset_format"),
        F.lit(sanitize_pii).alias("sanitize_pii"),
        F.lit(enforce_guardrails).alias("enforce_guardrails"),
        n.cast("bigint").alias("samples"),
        *[F.col(c) for c in CATEGORIES],
        F.col("rejected"),
    )
