"""Plan-shape checks: the scale properties the design relies on."""

import re

from pyspark.sql import functions as F

from loomset.operators import conversations as C
from loomset.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_notes_job_is_narrow(spark):
    plan = _plan(catalog.flagship(spark, SF))
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") <= 1  # none beside the dealing out of a small table
    for token in ["REDACTED_EMAIL", "REDACTED_PHONE", "REDACTED_SSN", "REDACTED_API_KEY", "REDACTED_IP"]:
        assert plan.count(token) == 1, token


def _exchange_keys(plan: str) -> list[list[str]]:
    return [[c.strip().split("#")[0] for c in k.split(",")[:-1]] for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


def _block_windows(spark):
    """Windows of table logs cut into blocks of two turns, so that every log has several."""
    from loomset.plans import dataset

    return dataset.table_log_samples(catalog.conversations_with_hits(spark, SF), "conv_id", "turn", "role", "text", block_size=2)


def test_short_logs_take_one_pass_and_one_shuffle(spark):
    plan = _plan(catalog.q_message_log_windows(spark, SF))
    # the table itself may have been dealt out on the log's key, which then serves the windows as well
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "ExistingRDD" not in plan
    short = {(r.conv_id, r.window_index): r.conversations_json for r in catalog.q_message_log_windows(spark, SF).collect()}
    blocks = _block_windows(spark).select("sample_id", F.to_json("conversations").alias("j")).collect()
    assert short == {tuple(int(x) for x in r.sample_id.split("#")): r.j for r in blocks}


def test_windows_broadcast_plan_shuffles_integer_ids(spark):
    """Small block table: broadcast map-side, rows shuffled on the block id, never with the file key."""
    plan = _plan(_block_windows(spark))
    keys = _exchange_keys(plan)
    assert ["_bid"] in keys, keys
    assert all("file" not in k for k in keys), keys
    assert "BroadcastExchange" in plan


def test_windows_fallback_never_shuffles_rows_on_file_alone(spark):
    """Broadcast off: rows move on (file, block); a file-only exchange only feeds the offset running sum."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(_block_windows(spark))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keys = _exchange_keys(plan)
    assert ["file", "block"] in keys, keys
    lines = plan.splitlines()
    checked = 0
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(file#\d+L?, \d+\)", line):
            assert "Sort" in lines[i - 1] and "Window [sum" in lines[i - 2], "\n".join(lines[i - 3 : i + 2])
            checked += 1
    assert checked >= 1


def test_table_windows_independent_of_block_size(spark):
    msgs = catalog._messages(spark, "/root/testdata/sf0.01").where("content <> ''")
    def windows(block):
        m = msgs.withColumn("block", (F.col("turn") / block).cast("bigint"))
        w = C.tumbling_windows(m, "conv_id", "block", "turn", "role", "content")
        return sorted((r.conv_id, r.window_index, r.n_messages, str(r.conversations)) for r in w.collect())
    assert windows(2) == windows(1 << 16)
    assert windows(3) == windows(1 << 16)


def test_two_level_assembly_equals_single_level(spark):
    from loomset.plans import dataset

    c = catalog.conversations_with_hits(spark, "/root/testdata/sf0.01")
    # one giant conversation: every message of the table under one key, ordered by (conv_id, turn)
    giant = c.withColumn("order", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.lit(7).cast("bigint"))

    def rows(df, **kw):
        s = dataset.table_conversation_samples(df, "conv_id", "order", **kw) if "order" in df.columns else dataset.table_conversation_samples(df, "conv_id", "turn", **kw)
        return sorted((r.sample_id, str(r.conversations)) for r in s.collect())

    assert rows(c, block_size=2) == rows(c)
    assert rows(giant, block_size=64) == rows(giant)
    assert len(rows(giant)) == 1


def test_windows_without_aqe_or_broadcast_shuffle_rows_once(spark):
    """Static plan, no broadcast: the offset table is re-shuffled to the rows' partitioning, not the rows."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = _plan(_block_windows(spark))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    row_exchanges = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
    assert len(row_exchanges) == 1, row_exchanges


def test_spread_deals_rows_to_all_cores(spark):
    """One row group: its rows reach every task, only the asked columns are read, and filters stay above the exchange."""
    docs = catalog.documents(spark, "/root/testdata/sf0.1")
    rows = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    cores = spark.sparkContext.defaultParallelism
    assert sum(rows) == 10000 and len(rows) == 2 * cores and max(rows) < 2 * 10000 / (2 * cores)
    plan = _plan(catalog.q_harm_filter(spark, "/root/testdata/sf0.1"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "ExistingRDD" not in plan
    assert plan.index("Filter") < plan.index("Exchange") < plan.index("FileScan")


def test_spread_leaves_filled_splits_alone(spark, tmp_dir):
    from loomset.sources import tables

    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(cores).write.parquet(f"{tmp_dir}/t.parquet")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a split per file
    try:
        assert "Exchange" not in _plan(tables.read_table(spark, tmp_dir, "t", "id"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def _write(path, text):
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_log_line_and_chat_messages_are_worked_out_once(spark, tmp_dir):
    """One extract per group of the log pattern; one verdict and one redaction chain per chat message."""
    from loomset.plans import dataset
    from loomset.sources import chat_tree, message_log

    _write(f"{tmp_dir}/log/a.txt", "1/2/24, 10:00:00 Ann: hi\n")
    plan = _plan(message_log.read_message_log(spark, f"{tmp_dir}/log"))
    assert plan.count("regexp_extract(") == 2 and "RLIKE" not in plan
    _write(f"{tmp_dir}/tree/a.json", '[{"mapping": {}}]')
    exports = chat_tree.read_chat_tree(spark, f"{tmp_dir}/tree")
    plan = _plan(dataset.chat_tree_samples(exports))
    assert plan.count("[REDACTED_EMAIL]") == 1 and plan.count("THEN hacking") == 1
    assert "Exchange hashpartitioning(file" in plan


LOG = [f"1/2/24, 10:{i // 60:02d}:{i % 60:02d} {'Ann' if i % 3 else 'Bob'}: message number {i} of the log" for i in range(600)]


def _windows(df):
    return sorted((r.sample_id.rsplit("#", 1)[1], str(r.conversations)) for r in df.collect())


def test_windows_do_not_depend_on_later_split_settings(spark, tmp_dir):
    """Settings and core counts that change between reading and running move no split and lose no message."""
    from loomset.plans import dataset

    _write(f"{tmp_dir}/log/a.txt", "\n".join(LOG) + "\n")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.autoBroadcastJoinThreshold"]
    old = {n: spark.conf.get(n, None) for n in names}

    def put(**values):
        for name, value in zip(names, values.values()):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

    want = None
    try:
        for limit in ("10485760", "-1"):  # both plans
            for later in ({"a": "4096", "b": "1024", "c": "4"}, {"a": "8192", "b": "1024", "c": "7"}):
                put(a="8192", b="1024", c="4", d=limit)
                df = dataset.read_samples(spark, "message_log", f"{tmp_dir}/log")
                put(**later, d=limit)
                got = _windows(df)
                assert sum(str(c).count("message number") for _, c in got) == 600
                want = want or got
                assert got == want
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_windows_fail_rather_than_lose_rows(spark, tmp_dir):
    import pytest

    from loomset.plans import dataset
    from loomset.sources import message_log

    _write(f"{tmp_dir}/log/a.txt", "\n".join(LOG) + "\n")
    lines = message_log.read_message_log(spark, f"{tmp_dir}/log")
    blocks = dataset.message_log_blocks(lines)
    for wrong in (blocks.withColumn("_n", F.col("_n") + 1), blocks.withColumn("_n", F.col("_n") - 1), blocks.withColumn("block", F.col("block") + 1)):
        for limit in ("10485760", "-1"):
            old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            try:
                with pytest.raises(Exception, match="changed between its two passes"):
                    dataset.message_log_samples(lines, blocks=wrong).collect()
            finally:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_broadcast_limit_reads_every_unit(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, value in (("1t", 1 << 40), ("10MB", 10 << 20), ("256k", 256 << 10), ("-1", -1), ("5", 5)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert C.broadcast_limit(spark) == value
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
