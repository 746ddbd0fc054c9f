import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyref
from loomset.functions import rules
from loomset.functions import text as T

REDACTION = [
    ("a@b.co", "[REDACTED_EMAIL]"),
    ("call (743) 555-3824 now", "call ([REDACTED_PHONE] now"),
    ("+1 (743) 555-3824", "+[REDACTED_PHONE]"),
    ("1.555.123.4567", "[REDACTED_PHONE]"),
    ("order 1234567890123", "order [REDACTED_PHONE]"),
    ("12345678901234", "12345678901234"),
    ("é5551234567", "é5551234567"),
    ("5551234567é", "5551234567é"),
    ("٥٥٥-١٢٣-٤٥٦٧", "[REDACTED_PHONE]"),
    ("x 123-45-6789", "x [REDACTED_SSN]"),
    ("key sk-" + "a" * 20, "key [REDACTED_API_KEY]"),
    ("sk-" + "1" * 20, "[REDACTED_API_KEY]"),
    ("sk-" + "1" * 10, "sk-[REDACTED_PHONE]"),
    ("AIzaSy" + "a" * 32 + "- end", "AIzaSy" + "a" * 32 + "- end"),
    ("ip 999.1.1.1", "ip [REDACTED_IP]"),
    ("155.512.345.678", "[REDACTED_IP]"),
    ("x.y@z.com555-123-4567", "[REDACTED_EMAIL][REDACTED_PHONE]"),
    ("", ""),
    (None, ""),
]

HARM = [
    ("SQL Injection demo", "hacking"),
    ("a pipe bomb and a botnet", "hacking"),
    ("a pipe bomb", "explosives"),
    ("erotica", "sexual"),
    ("murder plan", "harm"),
    ("keyloggers", None),
    ("", None),
    (None, None),
]


def test_whitespace_set_is_pythons():
    assert set(rules.WHITESPACE_CHARS) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_java_regex_expands_whitespace_inside_and_outside_classes():
    j = rules.java_regex(r"a\sb[-.\s]c")
    assert j.startswith("(?U)a[") and r"\s" not in j
    assert rules.java_regex(r"^x$", dotall=True) == r"(?Us)^x\z"


def test_redaction_goldens(spark):
    df = spark.createDataFrame(REDACTION, "t string, want string")
    for row in df.select("want", T.redact(F.col("t")).alias("got")).collect():
        assert row.got == row.want


def test_harm_goldens(spark):
    df = spark.createDataFrame(HARM, "t string, want string")
    for row in df.select("want", T.harm_category(F.col("t")).alias("got"), T.harm_category(F.col("t"), prefilter=False).alias("raw")).collect():
        assert row.got == row.want == row.raw


def test_strip_words_chunks(spark):
    df = spark.createDataFrame([("\x1c  a  b　c\n\x85",), ("",), ("    ",)], "t string")
    rows = df.select(T.strip(F.col("t")).alias("s")).withColumn("w", T.words(F.col("s"))).select(
        "s", "w", T.chunks(F.col("w"), 2).alias("c")
    ).collect()
    assert [r.s for r in rows] == ["a  b　c", "", ""]
    assert rows[0].w == ["a", "b", "c"] and rows[0].c == ["a b", "c"]
    assert rows[1].w == [] and rows[1].c == [] and rows[2].c == []


def test_clean_utf8(spark, tmp_dir):
    p = f"{tmp_dir}/bad.txt"
    with open(p, "wb") as f:
        f.write(b"a\xff\xc3(b\xe2\x82 end \xef\xbf\xbd")
    others = [b"ok \xef\xbf\xbd", b"ok \xef\xbf\xbd and bad \xff", "mark \ufdd0 \ufdd00 \ufdd01".encode() + b"\xff\xef\xbf\xbd", b"\xe2\x82\xef\xbf\xbd"]
    for i, data in enumerate(others):
        with open(f"{tmp_dir}/other{i}.txt", "wb") as f:
            f.write(data)
    paths = [p, *(f"{tmp_dir}/other{i}.txt" for i in range(len(others)))]
    rows = spark.read.text(paths, wholetext=True).select(T.clean_utf8(F.col("value")).alias("v")).collect()
    written = [b"a\xff\xc3(b\xe2\x82 end \xef\xbf\xbd", *others]
    assert sorted(r.v for r in rows) == sorted(d.decode("utf-8", errors="ignore") for d in written)


TOKENS = list("ab1234567890-.@ ()+:\n\tkxé٥\u0301\u200c\u200d²½ทรहि्_") + ["sk-", "pipe bomb", "Botnet", ".com", " ", "\x1c", "123-45-"]
TEXT = st.lists(st.sampled_from(TOKENS), max_size=30).map("".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(TEXT, min_size=150, max_size=150))
def test_differential_against_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t",
        T.redact(F.col("t")).alias("r"),
        T.harm_category(F.col("t")).alias("h"),
        T.strip(F.col("t")).alias("s"),
    ).collect()
    for row in rows:
        assert row.r == pyref.redact(row.t), row.t
        assert row.h == pyref.harm(row.t), row.t
        assert row.s == row.t.strip(), row.t


def test_trie_prefilter_equals_union_of_patterns():
    import random
    import re

    union = re.compile("|".join(p for ps in rules.HARM_PATTERNS.values() for p in ps))
    trie = re.compile(rules.any_harm_regex("re2"))
    phrases = rules.harm_phrases()
    assert len(phrases) == 43
    rnd = random.Random(3)
    tokens = phrases + ["a", "bomb", "pipe", "keyloggers", "x", " ", "-", "zero", "day", "how to", "kill", "rat", "c4", "_"]
    for _ in range(5000):
        s = "".join(rnd.choice(tokens) + rnd.choice(["", " ", "-", "."]) for _ in range(rnd.randint(1, 6)))
        assert bool(union.search(s)) == bool(trie.search(s)), s


def test_guarded_redaction_equals_plain(spark):
    from loomset.operators import guardrails as G

    texts = [t for t, _ in REDACTION] + ["no digits here", "mail x@y.io and 555-123-4567 at 10.0.0.1 key sk-" + "b" * 22, "٥٥٥-١٢٣-٤٥٦٧"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = G.redact_column(df, "t", out_col="g").select(
        "t", "g", T.redact(F.col("t")).alias("p"), T.redact_guarded(F.col("t")).alias("q")
    ).collect()
    assert all(r.g == r.p == r.q for r in rows)


# Literal results of the word-boundary rule: a word character is a letter, a number of any kind or the underscore.
BOUNDARY_REDACTION = [
    ("โทรที่0812345678", "โทรที่[REDACTED_PHONE]"),
    ("हिन्दी5551234567", "हिन्दी[REDACTED_PHONE]"),
    ("5551234567\u200c", "[REDACTED_PHONE]\u200c"),
    ("5551234567²", "5551234567²"),
    ("123-45-6789½", "123-45-6789½"),
    ("10.0.0.1\u0301", "[REDACTED_IP]\u0301"),
    ("sk-" + "a" * 24 + "\u0301", "[REDACTED_API_KEY]\u0301"),
    ("key AIzaSy" + "B" * 33 + " end", "key [REDACTED_API_KEY] end"),
    ("key ghp_" + "c" * 36 + " end", "key [REDACTED_API_KEY] end"),
]
BOUNDARY_HARM = [("pipe bomb\u0301", "explosives"), ("erotica\u200dx", "sexual"), ("keyloggers", None), ("a_botnet", None), ("botnet²", None)]


def test_word_boundary_is_pythons(spark):
    df = spark.createDataFrame([(a, b) for a, b in BOUNDARY_REDACTION], "t string, want string")
    for r in df.select("t", "want", T.redact(F.col("t")).alias("got")).collect():
        assert r.got == r.want == pyref.redact(r.t), r.t
    df = spark.createDataFrame(BOUNDARY_HARM, "t string, want string")
    for r in df.select("t", "want", T.harm_category(F.col("t")).alias("got"), T.harm_category(F.col("t"), prefilter=False).alias("plain")).collect():
        assert r.got == r.plain == r.want == pyref.harm(r.t), r.t
