"""Session defaults and the shared folder that iterative jobs write to.

Iterative operators cut their lineage once per round by writing the round's
tables under ``spark.checkpoint.dir`` (see :mod:`linkset.plans.workspace`).
On a cluster that setting must name a shared, fault-tolerant folder (HDFS, S3,
...); we only invent a folder when the session runs in local mode and nothing
is set, which is the case in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def _spark_context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect: no context on the client
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for round tables, reading the session first."""
    sc = _spark_context(spark)
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured and sc is not None:
        configured = sc.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        if sc is not None:
            sc.setCheckpointDir(configured)
        return configured
    master = sc.master if sc is not None else ""
    if not master.startswith("local"):
        raise RuntimeError(
            f"set {CHECKPOINT_CONF} to a shared folder (HDFS/S3/...) before "
            "running iterative graph operators on a cluster")
    local = tempfile.mkdtemp(prefix="linkset-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set(CHECKPOINT_CONF, local)
    return sc.getCheckpointDir() or local


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "linkset", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the bench; a cluster job brings its own."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
