"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []
#: What the innermost ``alone`` has written so far.
_on_the_way: ContextVar[list[str] | None] = ContextVar("_on_the_way", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored_path(spark: SparkSession) -> str:
    """A new path in the shared folder for what goes with the stored tables."""
    at = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _written.append(at)
    if (within := _on_the_way.get()) is not None:
        within.append(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later steps see the same rows, whatever executors are lost.

    The table goes with ``clear``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    at = stored_path(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, stored; those that it has stored on its way are deleted, as nothing else may read them."""
    written: list[str] = []
    token = _on_the_way.set(written)
    try:
        found = make()
    finally:
        _on_the_way.reset(token)
    out = stored(found)
    _delete(out.sparkSession, written)
    return out


def clear(spark: SparkSession) -> None:
    """Deletes all tables that ``stored`` has written. Call it where nothing that was computed from them is read any more."""
    _delete(spark, list(_written))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if at in _written:
            _written.remove(at)
