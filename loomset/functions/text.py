"""Column builders for text: strip, classify, redact, tokenise, chunk.

Every function maps ``Column -> Column`` with built-in Spark expressions only,
so the work stays inside whole-stage codegen and also works on lambda
variables of higher-order functions (``transform`` / ``filter``) and on
streaming DataFrames.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions import rules

# whitespace but the space, as a JVM class with two tests for a character: one table below U+0100, one range above
_LOW_WS = "".join(f"\\x{{{ord(ch):x}}}" for ch in rules.WHITESPACE_CHARS if ch < "\u0100" and ch != " ")
_HIGH_WS = [f"\\x{{{ord(ch):x}}}" for ch in sorted(rules.WHITESPACE_CHARS) if ch >= "\u0100"]
_OTHER_WS = f"[{_LOW_WS}[{_HIGH_WS[0]}-{_HIGH_WS[-1]}&&[{''.join(_HIGH_WS)}]]]"
_FFFD = "\ufffd"
_MARK = "\ufdd0"  # a noncharacter


def clean_utf8(c: Column) -> Column:
    """Drop invalid UTF-8 byte sequences, like decoding with ``errors="ignore"``.

    Valid strings pass untouched. In strings that carry invalid bytes a genuine
    U+FFFD is set aside under a mark before the repair, whose own U+FFFD then go;
    a mark that the text itself has is set aside in the same way.
    """
    marked = F.replace(F.replace(c, F.lit(_MARK), F.lit(_MARK + "0")), F.lit(_FFFD), F.lit(_MARK + "1"))
    repaired = F.replace(F.make_valid_utf8(marked), F.lit(_FFFD), F.lit(""))
    restored = F.replace(F.replace(repaired, F.lit(_MARK + "1"), F.lit(_FFFD)), F.lit(_MARK + "0"), F.lit(_MARK))
    return F.when(F.is_valid_utf8(c), c).otherwise(restored)


def strip(c: Column) -> Column:
    """``str.strip()``: remove Python whitespace at both ends (SQL ``trim`` only removes spaces)."""
    return F.trim(c, F.lit(rules.WHITESPACE_CHARS))


def harm_category(c: Column, prefilter: bool = True, tables: rules.RuleTables = rules.TABLES) -> Column:
    """First matching harm category of the lower-cased text, NULL when clean or empty.

    With ``prefilter`` one combined pattern is tried first; clean rows (nearly
    all of them) then pay for a single scan instead of one per category.
    """
    lowered = F.lower(c)
    verdict = None
    for category in tables.harm:
        cond = lowered.rlike(rules.harm_regex(category, harm=tables.harm))
        verdict = F.when(cond, F.lit(category)) if verdict is None else verdict.when(cond, F.lit(category))
    if verdict is None:
        return F.lit(None).cast("string")
    if not prefilter:
        return verdict
    if tables.harm is rules.HARM_PATTERNS:
        return F.when(lowered.rlike(rules.any_harm_regex()), verdict)
    needed = [rules.required_literals(p) for patterns in tables.harm.values() for p in patterns]
    guard = holds_any(lowered, needed)
    return verdict if guard is None else F.when(guard, verdict)


def holds_any(c: Column, needed: list[frozenset[str] | None]) -> Column | None:
    """``c`` holds one of the literals that some pattern needs; None if a pattern can do without known ones."""
    if not all(needed):
        return None
    literals = sorted(frozenset().union(*needed))
    plain = [re.escape(literal) for literal in literals if literal != rules.DIGIT]
    tests = [c.rlike("|".join(plain))] if len(plain) > 1 else [c.contains(literal) for literal in literals if literal != rules.DIGIT]
    tests += [has_digit(c)] if rules.DIGIT in literals else []
    return functools.reduce(lambda a, b: a | b, tests)


def redact(c: Column) -> Column:
    """Replace e-mails, phones, SSNs, API keys and IPv4 addresses, in that order; NULL -> ''."""
    out = F.coalesce(c, F.lit(""))
    for kind, pattern in rules.PII_PATTERNS.items():
        out = F.regexp_replace(out, rules.java_regex(pattern), rules.PII_REPLACEMENTS[kind])
    return out


def redact_step(kind: str, c: Column, tables: rules.RuleTables = rules.TABLES) -> Column:
    """One redaction (T2a-e) on ``c``."""
    return F.regexp_replace(c, rules.java_regex(tables.pii[kind]), rules.java_replacement(tables.replacements[kind]))


# Exact necessary conditions for a redaction to change the text: an e-mail
# needs '@', an API key one of its literal prefixes, and a phone / SSN / IP a
# digit. The replacement tokens contain neither '@' nor digits, so a condition
# tested before earlier steps still holds for the later ones.
def has_at_sign(c: Column) -> Column:
    return F.instr(c, "@") > 0


def has_key_prefix(c: Column) -> Column:
    return c.contains("sk-") | c.contains("AIzaSy") | c.contains("ghp_")


def has_digit(c: Column) -> Column:
    return c.rlike(r"(?U)\d")


def redact_guarded(c: Column, tables: rules.RuleTables = rules.TABLES) -> Column:
    """:func:`redact` run only where some redaction can apply, the e-mail step only where there is an ``@``; for a cheap
    ``c`` (a column or lambda variable)."""
    if tables is not rules.TABLES:
        out = c
        for kind in tables.pii:
            out = redact_step(kind, out, tables)
        # where no step finds what it needs in the text as it came, none changes it
        can_match = holds_any(c, [rules.required_literals(p) for p in tables.pii.values()]) if tables.pii else F.lit(False)
        kept = F.coalesce(c, F.lit(""))
        return F.coalesce(out, F.lit("")) if can_match is None else F.when(can_match, out).otherwise(kept)
    out = F.when(has_at_sign(c), redact_step("email", c)).otherwise(c)
    for kind in list(rules.PII_PATTERNS)[1:]:
        out = redact_step(kind, out)
    can_match = has_at_sign(c) | has_digit(c) | has_key_prefix(c)
    return F.when(can_match, out).otherwise(F.coalesce(c, F.lit("")))


def words(c: Column) -> Column:
    """``str.split()``: what stands between whitespace, [] for ''.

    A pattern that takes runs of whitespace costs more than all other steps of a note together, so every such character
    becomes a space first and the text is split at a literal space.
    """
    return F.array_remove(F.split(F.regexp_replace(c, _OTHER_WS, " "), " "), "")


def chunks(word_array: Column, size: int = rules.DEFAULT_CHUNK_WORDS) -> Column:
    """Consecutive groups of ``size`` words, each joined with one space.

    Pass a column reference, not an expression: the array is read once per
    chunk inside the lambda.
    """
    n = F.size(word_array)
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(word_array, i + 1, size), " "))).otherwise(
        F.array().cast("array<string>")
    )

