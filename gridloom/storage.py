"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the innermost scope() that this thread, or this context, is in.
_scope: ContextVar[str | None] = ContextVar("gridloom_scope", default=None)
#: Folders written by spool() outside any scope() in this process and not yet released, in order.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the context's own.

    Where neither is set, a session whose tasks run in the driver's process gets a temporary folder; any other is refused,
    since its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """A run of its own: what spool() writes inside goes to one folder, which is deleted at the end, whatever happens.

    Runs may follow, hold or interleave with one another, in one thread or in several: none deletes what another wrote.
    Frames that are to outlive the scope are written outside it, with ``spool(df, into=...)`` or anywhere else.
    """
    folder = f"{shared_folder(spark)}/gridloom-spool/run-{uuid.uuid4().hex}"
    before = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(before)
        delete(spark, folder)


def spool(df: DataFrame, into: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, and a lost executor costs nothing.

    into: a folder, such as that of a surrounding scope(); else that of the innermost scope, or, outside all, one of its own.
    """
    spark = df.sparkSession
    folder = into or _scope.get()
    path = f"{folder or shared_folder(spark) + '/gridloom-spool'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if into or folder is None:
        _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gl_path = path
    return out


def discard(spooled: DataFrame) -> None:
    """Delete what spool() wrote for this very frame; for when nothing reads it any more."""
    path = getattr(spooled, "_gl_path", None)
    if path:
        if path in _written:
            _written.remove(path)
        delete(spooled.sparkSession, path)


def mark() -> int:
    """How many spools there are; for release()."""
    return len(_written)


def release(spark: SparkSession, start: int = 0, end: int | None = None) -> None:
    """Delete the spools from ``start`` to ``end`` (see mark()); for when no frame reads them any more."""
    for path in _written[start:end]:
        delete(spark, path)
    del _written[start:end]


def clear_spool(spark: SparkSession) -> None:
    """Delete everything that spool() has written below the shared folder; for a job's end."""
    delete(spark, f"{shared_folder(spark)}/gridloom-spool")
    _written.clear()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
