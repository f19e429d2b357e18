"""Spark session helpers.

Cluster settings (shuffle partitions, AQE, checkpoint dir) come from the
session the user hands in; ``get_spark`` only fills what is unset, which is
what tests and the local bench need.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "maskloom") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("MASKLOOM_MASTER", "local[8]"))
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and snapshots.

    Read from ``spark.checkpoint.dir`` as the cluster names it. Only when it is
    unset (local tests) a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="maskloom-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def written(df, name: str):
    """Cut lineage by a written table in the shared checkpoint folder. Unlike a checkpoint its size is known to the
    planner, which broadcasts it in a join only below its own size limit."""
    import uuid
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark) -> None:
    """Have the driver collect its garbage, on which Spark's cleaner deletes the shuffle files of finished plans."""
    for _ in range(2):  # Python's references first, then what the JVM held for them; the cleaner works beside us
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def materialize(df):
    """Cut lineage by a written table: compressed, and read by column, where a checkpoint holds whole rows as they are."""
    return written(df, "rows")


def spread(df):
    """``df``, dealt out anew if it has fewer partitions than there are cores (few files, or files that are not split)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
