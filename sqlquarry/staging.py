"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset and all tasks run in the driver's process (tests) a temporary folder stands in for it;
    on a cluster it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sqlquarry.scratch", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sqlquarry-")
        spark.conf.set("spark.sqlquarry.scratch", named)
    return named.rstrip("/")


_KNOWN: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends in good order."""
    context = spark.sparkContext
    own = f"{shared_dir(spark)}/sqlquarry/{context.applicationId}"
    if own not in _KNOWN:
        _KNOWN.add(own)
        jvm, conf = context._jvm, context._jsc.hadoopConfiguration()

        def remove() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                path = jvm.org.apache.hadoop.fs.Path(own)
                path.getFileSystem(conf).delete(path, True)

        atexit.register(remove)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder for a table that goes when the driver ends."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that start here leave no shuffle files; else those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, frees shuffle files.

    The table is read again with its own schema, so an empty one keeps its columns.  ``by`` names a column of few
    values, whose rows get a folder for each.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    with _cleaned(spark):
        (writer.option("maxConcurrentOutputFileWriters", 8).partitionBy(by) if by else writer).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables, as ``stage`` returned them, that nothing reads any more; what was staged from them stays."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
