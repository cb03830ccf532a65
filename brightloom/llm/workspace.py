"""Shared-folder tables that cut lineage between the steps of an operator.

A table is ordinary Parquet below the folder that the cluster names in ``spark.checkpoint.dir``, so that a lost
executor costs a re-read and not a recomputation.  Only where that setting is absent (tests on one machine) a
temporary folder is used, and only with a local master.

An operator's tables and broadcasts live as long as its result may be read: to the end of the innermost ``scope``, or
of the interpreter where there is none.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch while a table is written: texts of many kilobytes pass through Python a few at a time.
ARROW_ROWS = 500
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_HASHES = 1 << 52
_scope: ContextVar[list | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="brightloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def scope() -> Iterator[None]:
    """Workspaces opened inside are closed at the end; what their operators returned must have been written by then."""
    own: list[Workspace] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for work in own:
            work.close()


def least_hashes(rows: DataFrame, key: Column, most: int, total: int, seed: int = 0) -> DataFrame:
    """The ``most`` rows with the least hashes of ``key``, by rank, so that a sample is full at every size.

    A range of hashes that holds about twice as many goes before the ranking, which then sees few rows."""
    hashed = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(_HASHES))
    upto = (2 * most + 100) / max(total, 1)
    if upto < 1:
        rows = rows.filter(hashed < max(int(upto * _HASHES), 1))
    return rows.orderBy(hashed, key).limit(most)


class Workspace:
    """Named Parquet tables, and broadcasts, of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/brightloom-tables/{name}-{uuid.uuid4().hex}"
        self._held: list = []
        own = _scope.get()
        if own is None:
            atexit.register(self.close)
        else:
            own.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows, and return them as read back."""
        path = f"{self.base}/{name}"
        rows = self.spark.conf.get(_ARROW)
        self.spark.conf.set(_ARROW, str(min(int(rows), ARROW_ROWS) if int(rows) > 0 else ARROW_ROWS))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_ARROW, rows)
        return self.spark.read.schema(df.schema).parquet(path)

    def broadcast(self, value):
        """A broadcast that ends with the workspace, or with ``forget``."""
        self._held.append(self.spark.sparkContext.broadcast(value))
        return self._held[-1]

    def forget(self, *held) -> None:
        """Destroy broadcasts that no later step reads."""
        for b in held:
            self._held.remove(b)
            b.destroy()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._delete(f"{self.base}/{name}")

    def close(self) -> None:
        """Delete everything."""
        try:
            self.forget(*self._held)
            self._delete(self.base)
        except Exception:  # the JVM may have ended first  # noqa: BLE001, S110
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
