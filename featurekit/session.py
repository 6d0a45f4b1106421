"""The folder that every executor can reach, for tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _this_machine() -> str:
    return tempfile.mkdtemp(prefix="featurekit-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Only where that is unset and
    Spark runs in this process alone is a temporary folder of this machine used. The folder goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _this_machine()
    path = f"{base.rstrip('/')}/featurekit-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Lazy results may read a folder until the process ends; then it goes."""
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
