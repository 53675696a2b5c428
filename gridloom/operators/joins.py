"""Range joins, anti joins and incremental selection.

Rectangles meet points by equality on the sheet and on a block of rows, then by a
residual test: a rectangle is written once for every block that it touches, so a join
never compares all rectangles of a sheet with all its points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.storage import spool

BLOCK = 64


def _block(row: Column, size: int) -> Column:
    return F.floor(row / size)


def _laid(boxes: DataFrame, size: int) -> DataFrame:
    return boxes.withColumn("gl_block", F.explode(F.sequence(_block(F.col("top"), size), _block(F.col("bottom"), size))))


def cell_regions(points: DataFrame, boxes: DataFrame, keys: list[str], order: list[str], size: int = BLOCK, once: int | None = None) -> DataFrame:
    """Every point (keys, row, col) with the first box by ``order`` that holds it, or nulls.

    boxes: keys, top, left, bottom, right, and the columns of ``order``.  A point meets the boxes of its block as one row, so
    points are neither multiplied nor joined again.  once: equal points are one, in so many tasks, without moving once more.
    """
    dealt = lambda df: df if once is None else df.repartition(once, *keys, "gl_block")
    place = F.struct(*dict.fromkeys([*order, "top", "left", "bottom", "right"]))
    held = dealt(_laid(boxes, size)).groupBy(*keys, "gl_block").agg(F.collect_list(place).alias("gl_boxes"))
    own = dealt(points.withColumn("gl_block", _block(F.col("row"), size)))
    if once is not None:
        own = own.distinct()
    inside = lambda b: F.col("row").between(b["top"], b["bottom"]) & F.col("col").between(b["left"], b["right"])
    # merged, since boxes are guessed to be as small as their files and would be sent to every task
    return own.join(held.hint("merge"), [*keys, "gl_block"], "left").withColumn("box", F.array_min(F.filter("gl_boxes", inside))).drop("gl_block", "gl_boxes")


def unclaimed(points: DataFrame, boxes: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """Points that lie in no box."""
    own = points.withColumn("gl_block", _block(F.col("row"), size)).alias("p")
    laid = _laid(boxes, size).alias("b")
    same = F.lit(True)
    for k in [*keys, "gl_block"]:
        same = same & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    inside = F.col("p.row").between(F.col("b.top"), F.col("b.bottom")) & F.col("p.col").between(F.col("b.left"), F.col("b.right"))
    return own.join(laid, same & inside, "left_anti").drop("gl_block")


def changed(current: DataFrame, previous: DataFrame, key: str, marks: list[str], failed: str | None = None) -> DataFrame:
    """Rows of ``current`` that are new, differ in a mark, or failed before."""
    known = previous if failed is None else previous.where(~F.col(failed))
    return current.join(known.select(key, *marks), [key, *marks], "left_anti")


def still_there(children: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Children of files that still exist: what a cascading delete leaves."""
    return children.join(files.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without those that new ones replace, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def selected(files: DataFrame, ids: list | None, key: str) -> DataFrame:
    """All files by name and id, or those given in the order given, each once, with its place."""
    from pyspark.sql.window import Window

    if ids is None:
        # places without a task that holds all files: ranges of names, and how many files the ranges before have
        ranged = spool(files.repartitionByRange("file_name", key).sortWithinPartitions("file_name", key).withColumn("gl_id", F.monotonically_increasing_id()))
        part = ranged.groupBy(F.shiftright("gl_id", 33).alias("gl_part")).agg(F.min("gl_id").alias("gl_first"), F.count("*").alias("gl_n"))
        before = Window.orderBy("gl_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = part.select("gl_part", "gl_first", F.coalesce(F.sum("gl_n").over(before), F.lit(0)).alias("gl_before"))
        out = ranged.withColumn("gl_part", F.shiftright("gl_id", 33)).join(starts, "gl_part")
        place = (F.col("gl_before") + F.col("gl_id") - F.col("gl_first") + 1).cast("int")
        return out.withColumn("place", place).drop("gl_part", "gl_first", "gl_before", "gl_id")
    wanted = list(dict.fromkeys(ids))
    order = F.array_position(F.array(*map(F.lit, wanted)), F.col(key)).cast("int")
    return files.where(F.col(key).isin(wanted)).withColumn("place", order)


def citations(cited: DataFrame, evidence: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Citations that match known evidence: same entity, field and text, letters in either case.

    cited, evidence: entity, field, text.
    """
    fold = lambda df: df.withColumn("gl_field", F.lower("field")).withColumn("gl_text", F.lower("text"))
    known = fold(evidence if allowed is None else evidence.where(F.col("entity").isin(allowed)))
    return fold(cited).join(known.select("entity", "gl_field", "gl_text"), ["entity", "gl_field", "gl_text"], "left_semi").drop("gl_field", "gl_text")
