"""Incremental scans: new files of a folder, each once, by a streaming file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import workbook
from gridloom.storage import spool

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Workbook files below a path as a stream; files seen before the checkpoint are not read again."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return found.where(F.lower(name).rlike(rf"\.({'|'.join(workbook.EXTENSIONS)})$") & ~name.rlike(r"^(~\$|\.)"))


def scan_new(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Append structure and cells of all files that are new since the last call, then stop.

    Batches carry their number: a batch that is written again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        with workbook.small_batches(spark):
            found = spool(workbook.read(workbook.hashed(batch)))
        for name, table in (("workbook", workbook.books(found)), ("cell", workbook.cells(found))):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    query = stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
