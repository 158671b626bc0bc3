"""Session helpers: building a session, the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. AQE re-plans joins at run time (broadcast when a
# shuffle stage turns out small, split skewed partitions of a join); the session
# time zone is pinned so that wall-clock timestamps never shift.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",   # no stack walk for every column that is built
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "linkflow", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one (local runs and tests).

    On a cluster the session already exists and its settings win; only unset
    keys are filled in.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there and it is used as is. Only
    when the setting is unset -- local runs and tests -- is a fresh local folder
    created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="linkflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and read it back.

    One job computes the data (a reliable ``checkpoint()`` of an uncached plan would
    compute it twice); the returned DataFrame has no lineage to its inputs, survives
    executor loss, and carries exact size statistics for the planner.
    """
    spark = df.sparkSession
    path = scratch_table_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
