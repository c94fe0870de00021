"""Session helpers.

The library never creates a session on its own inside operators; callers
pass one in. ``get_session`` is a convenience for tests, the bench and
the command-line entry points.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces
# partitions at run time; skew-join splits hot term partitions of the
# TF-IDF join. UTC keeps day buckets and ISO strings engine-independent.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "ticketlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """A session with the settings above. A master that spark-submit or the
    environment names is kept; local runs take ``BENCH_CPUS`` threads and
    as many shuffle partitions, a cluster Spark's own defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = dict(DEFAULT_CONF)
    builder = SparkSession.builder.appName(app)
    if master or not SparkConf().contains("spark.master"):
        builder = builder.master(master or f"local[{cpus}]")
        conf["spark.sql.shuffle.partitions"] = cpus
        conf["spark.driver.memory"] = os.environ.get("TICKETLENS_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def bounded_batches(spark: SparkSession, rows: int = 1024, megabytes: int = 16) -> None:
    """Bounds the Arrow batches that the next jobs send to Python workers, by
    rows and by bytes: a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. It is set once: from
    ``spark.checkpoint.dir`` where the cluster names one; a local session
    without one (tests, bench) gets a scratch folder; a cluster without one
    is an error, as executors do not share the driver's local folders."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ticketlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()
