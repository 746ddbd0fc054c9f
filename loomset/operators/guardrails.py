"""Guardrails (harm classification and filter) and PII redaction on DataFrames.

The verdict is computed once per row into ``harm_category`` and every later
step (the kept branch, the rejection counts) reads that column, so the regex
work is never repeated. Both steps can be switched off; switched off, the
verdict column is a NULL literal and the counts stay zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T

HARM = "harm_category"


def classify(df: DataFrame, text_col: str, enabled: bool = True, tables: rules.RuleTables = rules.TABLES) -> DataFrame:
    """Add ``harm_category`` (NULL = clean) computed on the unredacted text."""
    verdict = T.harm_category(F.col(text_col), tables=tables) if enabled else F.lit(None).cast("string")
    return df.withColumn(HARM, verdict)


def keep_clean(df: DataFrame) -> DataFrame:
    """Rows whose verdict is clean."""
    return df.where(F.col(HARM).isNull())


def redact_column(
    df: DataFrame, text_col: str, enabled: bool = True, out_col: str | None = None, tables: rules.RuleTables = rules.TABLES
) -> DataFrame:
    """Redact personal data in ``text_col`` (T2); with ``enabled=False`` NULL still becomes ''.

    Same result as :func:`loomset.functions.text.redact`, but each regex runs
    only on rows that can match it (few texts hold an '@', a key prefix or
    even a digit). The steps are separate projected columns: a guard reads its
    input twice, and Catalyst keeps a non-trivial column that is read more
    than once computed once instead of inlining it.
    """
    out_col = out_col or text_col
    source = F.coalesce(F.col(text_col), F.lit(""))
    if not enabled:
        return df.withColumn(out_col, source)
    if tables is not rules.TABLES:
        cols = [f"_r{k}" for k in range(len(tables.pii) + 1)]
        r = df.withColumn(cols[0], source)
        for before, after, kind in zip(cols, cols[1:], tables.pii):
            c = F.col(before)
            step, guard = T.redact_step(kind, c, tables), T.holds_any(c, [rules.required_literals(tables.pii[kind])])
            r = r.withColumn(after, step if guard is None else F.when(guard, step).otherwise(c))
        return r.withColumn(out_col, F.col(cols[-1])).drop(*cols)
    cols = ["_r0", "_r1", "_rd", "_r3", "_r4"]
    r = df.withColumn("_r0", source)
    r = r.withColumn("_r1", F.when(T.has_at_sign(F.col("_r0")), T.redact_step("email", F.col("_r0"))).otherwise(F.col("_r0")))
    r = r.withColumn("_rd", T.has_digit(F.col("_r1")))
    phone_ssn = T.redact_step("ssn", T.redact_step("phone", F.col("_r1")))
    r = r.withColumn("_r3", F.when(F.col("_rd"), phone_ssn).otherwise(F.col("_r1")))
    r = r.withColumn("_r4", F.when(T.has_key_prefix(F.col("_r3")), T.redact_step("api_key", F.col("_r3"))).otherwise(F.col("_r3")))
    r = r.withColumn(out_col, F.when(F.col("_rd"), T.redact_step("ip", F.col("_r4"))).otherwise(F.col("_r4")))
    return r.drop(*cols)
