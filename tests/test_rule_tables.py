"""Rule tables as arguments, and the literals that guards and prefilters derive from their patterns."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.functions import text as T
from loomset.operators import guardrails as G
from loomset.plans import dataset

OWN = rules.RuleTables(
    harm={"leak": [r"\binternal only\b", r"\bdo not (?:share|forward)\b"], "money": [r"\b\d+ (?:euro|dollar)s?\b"]},
    pii={"ticket": r"\b(?:JIRA|OPS)-\d+\b", "host": r"[a-z0-9-]+@[a-z]+", "plate": r"\b[A-Z]{2}\s\d{3}\b", "all_a": r"aa+"},
    replacements={"ticket": "<$1\\ticket>", "host": "HOST-1@x", "plate": "", "all_a": "A"},
)
TEXTS = ["", None, "nothing here", "Do NOT share OPS-12 with x@host", "JIRA-9 and OPS-77, XOPS-1", "12 euros", "AB 123 aaa", "aa@bb 7 Dollar",
         "INTERNAL ONLY", "a-b@c OPS-", "$1 \\1 OPS-1"]


def _plain(text):
    low = (text or "").lower()
    verdict = next((c for c, ps in OWN.harm.items() if any(re.search(p, low) for p in ps)), None)
    out = text or ""
    for kind, pattern in OWN.pii.items():
        out = re.sub(pattern, lambda _, kind=kind: OWN.replacements[kind], out)
    return verdict, out


def test_literals_of_the_fixed_patterns():
    digit = frozenset([rules.DIGIT])
    want = {"email": frozenset("@"), "phone": digit, "ssn": digit, "api_key": frozenset(["sk-", "AIzaSy", "ghp_"]), "ip": digit}
    assert {kind: rules.required_literals(p) for kind, p in rules.PII_PATTERNS.items()} == want


@pytest.mark.parametrize("pattern, needed", [
    (r"ab?c", {"a"}), (r"(?:ab|cd)+x", {"ab", "cd"}), (r"(?:ab|c?)", None), (r"[ab]\d{2,}", {rules.DIGIT}), (r"(?i)abc", None),
    (r"(?:abc)*", None), (r"x(?:abc){0,3}", {"x"}), (r"a(?i:bcd)", {"a"}), (r".*", None), (r"(?=abc)d", {"d"}), (r"", None),
])
def test_required_literals(pattern, needed):
    got = rules.required_literals(pattern)
    assert got == (None if needed is None else frozenset(needed))


@settings(max_examples=400, deadline=None)
@given(st.text("abSK-9@ ", max_size=12), st.sampled_from([r"(?:sk|ab)-?9", r"a+@(?:b|9)", r"(?:a|b9)\d", r"\ba[b@]9?", r"(?:a(?:b|S)+)+-"]))
def test_every_match_holds_a_required_literal(text, pattern):
    needed = rules.required_literals(pattern)
    for m in re.finditer(pattern, text):
        assert any(re.search(r"\d", m[0]) if n == rules.DIGIT else n in m[0] for n in needed)


def test_own_tables_on_columns(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    judged = G.redact_column(G.classify(rows, "t", tables=OWN), "t", out_col="clean", tables=OWN)
    got = judged.select("k", G.HARM, "clean", T.redact_guarded(judged.t, OWN).alias("guarded"), T.harm_category(judged.t, False, OWN).alias("plain"))
    for row in got.collect():
        assert (row[G.HARM], row.clean) == (row.plain, row.guarded) == _plain(TEXTS[row.k])


def test_tables_without_rules(spark):
    none = rules.RuleTables(harm={}, pii={}, replacements={})
    rows = spark.createDataFrame([("ransomware a@b.cc",), (None,)], "t string")
    got = G.redact_column(G.classify(rows, "t", tables=none), "t", tables=none)
    assert sorted(map(tuple, got.select("t", G.HARM, T.redact_guarded(F.col("t"), none)).collect())) == [
        ("", None, ""), ("ransomware a@b.cc", None, "ransomware a@b.cc")
    ]


def test_own_tables_through_every_source(spark, tmp_dir):
    import json
    import os

    os.makedirs(f"{tmp_dir}/n")
    os.makedirs(f"{tmp_dir}/l")
    said = ["Do NOT share this", "see OPS-12 now", "cost is 12 euros", "plain words", "ransomware is fine here"]
    for k, text in enumerate(said):
        with open(f"{tmp_dir}/n/{k}.txt", "w") as f:
            f.write(text + " and so on" * 6)
    with open(f"{tmp_dir}/l/a.txt", "w") as f:
        f.writelines(f"[1/2/24, 10:00:00 AM] ann: {text}\n" for text in said)
    nodes = {str(k): {"message": {"author": {"role": "user"}, "content": {"parts": [text]}}} for k, text in enumerate(said)}
    with open(f"{tmp_dir}/t.json", "w") as f:
        json.dump([{"mapping": nodes}], f)
    for kind, path, samples in (("notes", "n", 3), ("message_log", "l", 1), ("chat_tree", "t.json", 1)):
        out = f"{tmp_dir}/out-{kind}"
        summary = dataset.build_dataset(spark, kind, f"{tmp_dir}/{path}", out, "jsonl", tables=OWN)
        assert (summary["samples"], summary["leak"], summary["money"], summary["rejected"]) == (samples, 1, 1, 2)
        assert "hacking" not in summary
        text = "".join(r.value for r in spark.read.text(out).collect())
        assert "ransomware" in text and "OPS-12" not in text and "<$1\\\\ticket>" in text


def test_tables_are_checked():
    with pytest.raises(ValueError, match="no replacement for x"):
        rules.RuleTables(pii={"x": "a"}, replacements={})
    with pytest.raises(ValueError, match="not a name"):
        rules.RuleTables(harm={"rejected": ["a"]})
    with pytest.raises(ValueError, match="no pattern"):
        rules.RuleTables(harm={"x": []})
    with pytest.raises(re.error):
        rules.RuleTables(harm={"x": ["("]})
