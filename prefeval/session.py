"""Spark session settings used by tests, bench and the driver entry.

The library itself never changes cluster settings it is handed: it reads
``spark.checkpoint.dir`` from the session and only fills it in when the
session has none (local tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings that matter for every plan in this package: AQE re-plans joins
# and partition counts at run time, and splits skewed join partitions.
# Broadcasts come only from explicit ``broadcast()`` on tables with a size
# bound (literals, per-language tables) or from AQE after it has measured a
# finished shuffle stage; never from a static estimate, which can put a
# data-sized table (exploded tokens) on the broadcast side.
DEFAULT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "prefeval", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    active = SparkSession.getActiveSession()
    if active is None and not SparkConf().contains("spark.driver.memory") \
            and "spark.driver.memory" not in (extra or {}):
        # local runs: executors live in the driver JVM, give it room
        builder = builder.config("spark.driver.memory", "12g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; without it executors could not read each other's tables, so
    its absence is an error. Only a local session gets a scratch folder, which
    goes when the process ends."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="prefeval-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint dir (one per call)."""
    import uuid
    return scratch_path(spark, f"prefeval-{name}-{uuid.uuid4().hex[:10]}")


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: cuts the lineage (a lost executor re-reads the table, it
    does not recompute it), runs the producing job exactly once (unlike an
    unpersisted RDD checkpoint) and gives the planner real size statistics."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
