"""Folders for tables that an operation keeps for a while."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder:
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="brightloom-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not known.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; it is deleted when the interpreter ends."""
    path = f"{shared_folder(spark)}/brightloom-kept/{name}-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            delete(spark, path)
        except Exception:  # the JVM may have ended first  # noqa: BLE001, S110
            pass

    atexit.register(forget)
    return path
