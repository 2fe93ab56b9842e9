"""Session settings the operators are tuned for."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "leafledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster.

    Where the setting is missing, a folder of this machine is made only if driver and
    executors are one process; on a cluster that is an error, as each machine would have
    its own.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    context_dir = spark.sparkContext.getCheckpointDir()
    if configured:
        if context_dir is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context_dir is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafledger-"))
        context_dir = spark.sparkContext.getCheckpointDir()
    return context_dir.rstrip("/")


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
