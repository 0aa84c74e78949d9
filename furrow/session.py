"""Session helper and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Join hint for sides made by explode() or Python: Spark's estimate of a side doesn't grow with
#: the rows that these add, so without it such sides are collected by the driver for a broadcast.
BY_SORT = "merge"

#: The folder of the innermost passing_tables() of this thread.
_passing: ContextVar[str | None] = ContextVar("passing", default=None)


def get_spark(app: str = "furrow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent and executors are threads of this process
    (master local), a temporary folder is made and set, so that later calls in the same
    session find the same one. On a cluster a missing setting is an error: each executor
    would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="furrow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/furrow/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{_passing.get() or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared folder, if it is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes to the shared folder inside the block are deleted at its end.

    What is to last must be written inside the block, to a path from outside it.
    """
    folder = fresh_path(spark, "passing")
    before = _passing.set(folder)
    try:
        yield
    finally:
        _passing.reset(before)
        discard(spark, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that have not been read out are lost with them."""
    discard(spark, scratch_dir(spark))


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder (or to path) and read it back.

    The result has no lineage: a lost executor costs a re-read, not a re-run. The table
    stays until clear_scratch(), or the end of the passing_tables() that it is written in.
    """
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
