"""Session helpers: a local session for tests / bench and the shared work folder.

Jobs never write to a machine-local temporary folder on a cluster: anything
materialised (rendered source files, stream checkpoints, lineage cuts) goes
under the folder the cluster names in ``spark.checkpoint.dir``. Only a
local-mode session without that setting (tests, bench) gets a fresh folder of
its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # a listing job over many paths (e.g. a file-stream batch) gets one task per path by
    # default (up to 10,000); on one machine a few tasks list them faster
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32",
    # local disk only: skip Hadoop's .crc side files (renders write many small files)
    "spark.hadoop.fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "spark.hadoop.fs.file.impl.disable.cache": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "loomset", **conf: str) -> SparkSession:
    """``local[cores]`` session with AQE on and the UI off (tests and bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared work folder (``spark.checkpoint.dir``).

    Read from the session; set only when unset and the session is local, as in
    tests. A cluster session without the setting is an error rather than a
    silent fallback to a node-local path.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: no SparkContext, read the setting itself
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="loomset-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
