"""Where intermediate tables go: the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder of its own; on a
    cluster each executor would write to its own disk.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="paytally-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Used where several consumers need one result: it is computed once, survives the loss of
    executors, and gives the planner true sizes for its join choices.
    """
    return write_at(df, fresh_path(df.sparkSession, label))


def write_at(df: DataFrame, path: str) -> DataFrame:
    with shuffles_cleared(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind; Spark would keep them until the driver collects the plan."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder inside its file system; the target must not be there yet."""
    place, system = _place(spark, source)
    to, _ = _place(spark, target)
    system.mkdirs(to.getParent())
    if system.exists(to) or not system.rename(place, to):
        raise OSError(f"{source} cannot be moved to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds."""
    place, system = _place(spark, path)
    return sorted(entry.getPath().getName() for entry in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more, on whatever file system it is."""
    place, system = _place(spark, path)
    system.delete(place, True)
