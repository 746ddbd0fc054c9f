import os

import pytest

import oracle_check
from __spark_entry__ import entry, oracle_sql, queries
from loomset.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


def test_entry_flagship(spark):
    df = entry(spark)
    assert df.columns == ["doc_id", "chunk_index", "instruction", "input", "output"]
    assert df.count() == 263


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.ORACLE)
    assert set(catalog.QUERIES) <= set(queries()) and set(oracle.ORACLE) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_duckdb(spark, name):
    oracle_check.SF_DIR_HOLDER[0] = SF
    con = oracle_check.duck(SF)
    ok, msg = oracle_check.compare(spark, con, name, queries()[name], oracle_sql()[name])
    assert ok, msg


def test_survey_expected_values(spark):
    from pyspark.sql import functions as F

    from loomset.functions import rules
    from loomset.functions import text as T
    from loomset.operators import conversations as C
    from loomset.operators import notes as N

    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    p = N.prepare_notes(d, "text")
    tokens = {k: F.sum(F.size(F.split("body", F.lit("\\[" + r[1:-1] + "\\]"))) - 1).alias(k) for k, r in rules.PII_REPLACEMENTS.items()}
    got = p.select(*tokens.values(), F.sum((F.col("body") != T.strip(F.col("text"))).cast("int")).alias("changed")).first()
    assert (got.email, got.phone, got.ssn, got.api_key, got.ip, got.changed) == (12, 19, 0, 0, 32, 43)
    chunks = N.chunk_notes(p, keep_cols=["doc_id"])
    assert chunks.count() == 1343
    assert d.count() - chunks.select("doc_id").distinct().count() == 12
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    msgs = c.select("conv_id", "turn", "role", T.strip(F.col("text")).alias("content"))
    assert C.assemble(C.message_filter(msgs), ["conv_id"], "turn").count() == 98
    # with the chat role filter the six-message windows are 127, 111 of them with >= 2 messages
    kept = C.message_filter(msgs).withColumn("block", F.lit(0).cast("bigint"))
    windows = C.tumbling_windows(kept, "conv_id", "block", "turn", "role", "content", min_turns=1)
    assert windows.count() == 127 and windows.where("n_messages >= 2").count() == 111


def test_entry_without_the_llm_part(tmp_path):
    """Without the llm folders and the corpus pipeline the rest is there as before; other import errors are not hidden."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/loomset", tmp_path / "loomset", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run().stdout.split() == ["True", str(len(catalog.QUERIES))]
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr
