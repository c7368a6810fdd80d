"""Intermediate tables in the cluster's shared folder.

A frame that several passes read is written once as Parquet and read back. That
cuts its lineage, survives the loss of any executor, and gives the planner its
real size on disk: Spark then broadcasts it only while its files stay below
``spark.sql.autoBroadcastJoinThreshold`` and uses a sort-merge join (split by AQE
where a key is hot) beyond that. No broadcast hint is used anywhere.

A lazy result may still read stored tables, so they stay, like checkpoint files. A job
that writes its outputs wraps its work in ``scratch``, which removes the tables stored
inside once the block is left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = "8000"  # the JVM compiles no longer method, and would interpret it row by row

_local_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="fluxloom-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables stored in this block when it ends; only what was written elsewhere remains."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for this block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def compiled(spark: SparkSession):
    """A block whose generated methods the JVM can compile; longer ones run operator by operator."""
    return settings(spark, **{METHOD_LIMIT: COMPILED_BYTES})


def write(df: DataFrame, path: str, *folders: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path``, drop the shuffle files that this took, and return the frame that reads it.

    Rows are kept apart by the columns ``folders``.

    Nothing reads those files again, and Spark would keep them until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    with compiled(spark), settings(spark, **{SHUFFLE_CLEANUP: "true"}):
        (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared path as Parquet and return the frame that reads it."""
    return write(df, fresh_path(df.sparkSession, name))
