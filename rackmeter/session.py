"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Building plans takes much less time without a stack trace per column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app: str = "rackmeter", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or get) a session; ``extra`` takes further settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which every executor can reach.

    Without that setting a session on one machine gets a temporary folder; one on a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rackmeter-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path on the mounted file system, None if it is on another one."""
    if path.startswith("file:"):
        return os.path.normpath("/" + path[5:].lstrip("/"))
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return os.path.abspath(path) if re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", path) is None and default.startswith("file:") else None


def mounted_scratch(spark: SparkSession, label: str) -> str | None:
    """A fresh scratch path that tasks can mount, None if there is no such folder."""
    try:
        return mounted_path(spark, scratch_path(spark, label))
    except ValueError:
        return None


def wide(spark: SparkSession) -> int:
    """Tasks for many small items whose number is not known: some for each core."""
    return 4 * spark.sparkContext.defaultParallelism
