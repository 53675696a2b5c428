"""A folder of workbooks followed as it changes: new files, changed ones and those that went, each taken once.

    watch(spark, "/data/workbooks", "/out")     # as often as wanted; reads what differs from the last call
    assess(current(spark, "/out"))              # of the files that are there now

A call appends to the event log what differs from it (``announce``), and a stream over the log keeps the last version and hash
of every path as its state (``changes``).  The state tells real changes from files that were only touched, and
from events that come again; its paths stay in it when their files go, so that an old event never brings a file back.

Defined results: of several events of a path the one of the greatest version counts, of equal versions the one with the
greater hash, a gone one last; rows without a path or a version are left out; a file with the hash it had is no change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.plans import portfolio
from gridloom.sources import workbook
from gridloom.storage import scope, spool

EVENT = "path string, version long, length long, modified timestamp, sha string"
CHANGE = "path string, version long, sha string, change string"
_STATE = "version long, sha string"
TABLES = ("workbook", "sheet", "cell", "formula", "region", "occupancy")


def latest(log: DataFrame) -> DataFrame:
    """The last event of every path: path, version, length, modified, sha (null: gone)."""
    newest = F.max(F.struct("version", "sha", "length", "modified")).alias("e")
    return log.where("path is not null and version is not null").groupBy("path").agg(newest).select("path", "e.*")


def contents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The files below a path whose path and time are among ``wanted`` (path, modified), with their content.

    The bounds of the times are pushed to the source: files outside them are listed, but not read.
    """
    found = workbook.discover(spark, path)
    first, last = wanted.agg(F.min("modified"), F.max("modified")).first()
    near = found.where(F.lit(False)) if first is None else found.where(F.col("modificationTime").between(first, last))
    return near.join(wanted.select("path", F.col("modified").alias("modificationTime")), ["path", "modificationTime"], "left_semi")


def announce(spark: SparkSession, path: str, log: str) -> None:
    """Append to the event log the files below a path that are new or have another size or time than in it, and those that went.

    One writer at a time.  Where a call has failed half-way, the next one appends what is missing.
    """
    spark.createDataFrame([], EVENT).write.mode("append").parquet(log)
    with scope(spark):
        known = spool(latest(spark.read.schema(EVENT).parquet(log)))
        version = (known.agg(F.max("version")).first()[0] or 0) + 1
        here = spool(workbook.discover(spark, path).select("path", "length", F.col("modificationTime").alias("modified")))
        differs = spool(here.join(known.where("sha is not null"), ["path", "length", "modified"], "left_anti"))
        read = workbook.hashed(contents(spark, path, differs)).select("path", F.lit(version).alias("version"), F.octet_length("content").cast("long").alias("length"), F.col("modificationTime").alias("modified"), "sha")
        gone = known.where("sha is not null").join(here, "path", "left_anti").select("path", F.lit(version).alias("version"), "length", "modified", F.lit(None).cast("string").alias("sha"))
        read.unionByName(gone).withColumn("version", F.col("version").cast("long")).write.mode("append").parquet(log)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change of one path, if its newest event is one; the state is the newest event seen."""
    seen, before = state.get if state.exists else (None, None)
    best = None
    for b in batches:
        for version, sha in zip(b["version"], b["sha"], strict=True):
            event = (int(version), "" if sha is None or sha != sha else sha)
            best = event if best is None else max(best, event)
    if best is None or (seen is not None and best <= (seen, before or "")):
        return
    version, sha = best[0], best[1] or None
    state.update((version, sha))
    if sha != before:
        change = "gone" if sha is None else "new" if before is None else "changed"
        yield pd.DataFrame({"path": [key[0]], "version": [version], "sha": [sha], "change": [change]})


def changes(events: DataFrame) -> DataFrame:
    """A stream of events (path, version, sha; null: gone) as a stream of changes: at most one row a path and batch."""
    slim = events.where("path is not null and version is not null").select("path", F.col("version").cast("long").alias("version"), "sha")
    return slim.groupBy("path").applyInPandasWithState(_step, CHANGE, _STATE, "update", GroupStateTimeout.NoTimeout)


def live(changed: DataFrame) -> DataFrame:
    """What is there now by what a stream of changes gave: path, version, sha."""
    last = changed.groupBy("path").agg(F.max(F.struct("version", "sha", "change")).alias("c"))
    return last.where("c.change <> 'gone'").select("path", "c.version", "c.sha")


def watch(spark: SparkSession, path: str, out: str, max_rows: int = workbook.MAX_ROWS) -> None:
    """Take in what has changed below a path since the last call, then stop.

    A batch's tables lie in a folder of its number, which a batch that runs again replaces.  A file that changes
    while it is read is left to the next call.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scope(spark):
            change = spool(batch)
            # the first batch lays down every table, an empty one too
            if number and change.isEmpty():
                return
            told = spark.read.schema(EVENT).parquet(f"{out}/event").join(change.where("change <> 'gone'"), ["path", "version", "sha"], "left_semi")
            told = spool(told.select("path", "modified", "sha"))
            if number and told.isEmpty():
                change.write.mode("overwrite").parquet(f"{out}/change/batch={number}")
                return
            files = workbook.hashed(contents(spark, path, told)).join(told.select("path", "sha").distinct(), ["path", "sha"], "left_semi")
            tables = portfolio.tables_of(files, max_rows)
            for name in TABLES:
                tables[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
            # last: what current() goes by
            change.write.mode("overwrite").parquet(f"{out}/change/batch={number}")

    announce(spark, path, f"{out}/event")
    events = spark.readStream.schema(EVENT).parquet(f"{out}/event")
    query = changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, out: str) -> portfolio.Tables:
    """The tables of ``watch``, of the files that are there now: each file as it was read last, each content once."""
    change = spark.read.parquet(f"{out}/change")
    last = change.groupBy("path").agg(F.max(F.struct("version", "batch", "change")).alias("c")).where("c.change <> 'gone'").select("path", "c.batch")
    book = spool(spark.read.parquet(f"{out}/workbook").join(last, ["path", "batch"], "left_semi"))
    # files with one content share a key: its cells are those of one batch
    keys = book.groupBy("file_pk").agg(F.max("batch").alias("batch"))
    rest = {name: spark.read.parquet(f"{out}/{name}").join(keys, ["file_pk", "batch"], "left_semi").drop("batch") for name in TABLES[1:]}
    return {"workbook": book.drop("batch")} | rest
