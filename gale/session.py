"""Spark session construction and the shared checkpoint folder.

Every job in the package is a lazy DataFrame transformation; the only session
state it relies on is UTC time, ANSI mode (Spark 4 default) and AQE, so the
same plans run on ``local[8]`` and on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job assumes. AQE coalesces small shuffle partitions and
# splits skewed join partitions at run time; the broadcast threshold is the
# size check behind every implicit broadcast.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of a query are removed once their RDD is unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "gale",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cutting lineage.

    The cluster names it in ``spark.checkpoint.dir``; only a local session
    (one machine, tests) may go without, and then gets one of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gale-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 - some deployments make it read-only
            pass
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df):
    """Cut lineage: ``checkpoint()`` ``df`` eagerly into the shared checkpoint
    folder and return the re-read table. Used where one derived input feeds
    several branches of a plan, so the source is computed once instead of
    per branch. (Measured on Spark 4.1: the eager checkpoint computes its
    input once; writing a parquet table instead cost more for the same
    effect.) Files are removed when the table is no longer referenced
    (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
