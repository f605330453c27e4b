"""Written intermediate tables.

A result that several branches of a job read, or whose row placement must not be
computed twice, is written once to the shared folder named by `spark.checkpoint.dir`
and read back. The table survives lost executors and is pruned by column like any
other Parquet table. Tables of a finished piece of work go with its `scratch_scope`.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Paths of the innermost scope that is open, if any.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="codeaudit-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below a folder of this application, which goes when the application ends."""
    folder = f"{scratch_root(spark)}/codeaudit-{spark.conf.get('spark.app.id')}"
    if getattr(spark, "_jvm", None) is not None:
        fs, path = _file_system(spark, folder)
        fs.deleteOnExit(path)
    made = f"{folder}/{label}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append(made)
    return made


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables written within when the work ends, whether it fails or not.

    Nothing that is read later may come from them: write results elsewhere before the end.
    """
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for name in made:
            delete_path(spark, name)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of each query run within as it ends, not when the driver next collects its garbage.

    For work whose steps are each written once and read back as tables; a query that
    runs a second time makes its shuffles anew.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def delete_path(spark: SparkSession, name: str) -> None:
    """Delete a folder that this application wrote, if it is there."""
    fs, path = _file_system(spark, name)
    fs.delete(path, True)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Whether some file or folder matches the pattern, in whatever store it names."""
    fs, path = _file_system(spark, pattern)
    found = fs.globStatus(path)
    return found is not None and len(found) > 0


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
