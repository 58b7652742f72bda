"""Cutting lineage in iterative plans with tables in the cluster's shared folder.

A DataFrame loop needs its lineage cut.  ``Dataset.checkpoint`` computes the plan twice and
stores uncompressed rows, so the loops here write parquet below ``spark.checkpoint.dir`` and
read it back: a lost executor then costs a task, never the loop.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's setting, else (tests, local mode) a temporary one.

    Raises where a cluster session names none, since a machine-local folder would lose data there.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jdir.get() if jdir.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{_KEY} must name a shared folder on a cluster")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="mnemospark-"))
        atexit.register(shutil.rmtree, _local_folder[0], True)
    return "file://" + _local_folder[0]


_lock = threading.Lock()
_writers = 0
_before = "false"


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """The session deletes shuffle files of finished plans while any staging write runs, also of several threads."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.set(_CLEANUP, _before)


class Staging:
    """A folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        # results are read lazily, so what is not dropped before goes when the session's process ends
        target = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)

    def cut(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return the table read back, with ``staged_path`` naming its place.

        The shuffle files of the written plan are of no use afterwards and are deleted at once.
        """
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        schema = df.schema
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with _cleaning(self.spark):
            writer.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.staged_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later plan reads."""
        path = getattr(df, "staged_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
