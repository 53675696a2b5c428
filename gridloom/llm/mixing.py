"""Mixing sources to target weights by systematic sampling, DataFrame functions only.

A source's target is its share, by weight, of ``BUDGET`` times all words, at most
``CAP`` times its own words; what it cannot take is shared again by weight.  All its
documents expect target / size copies.  In an order by size (equal sizes by a seeded
hash), a prefix sum of expected copies runs over the source from one random offset,
and a document is emitted once for every integer boundary that its own step crosses.
Since the order is by size, the words taken differ from the target by about one
longest document at most.

Documents are dealt to tasks by ranges of that order, so neither a large source nor a frequent
size makes a large task, and numbered there; the counts of every task and source, a few
numbers each, are summed up to where each task's documents of a source begin.  Targets are
set in one task over the table of sources, one row each.

Sizes and counts are found by actions that run while the result is built.

Defined results: a null source is a source of its own, the last; a null or empty text
has size 0 and takes no words; a very long text has all its words counted, and may miss or
exceed a target by its size; a source without words has target 0; equal texts and repeated
rows are drawn one by one; an empty table gives no rows; ``mixed`` returns all columns as they
were, whatever their names, and adds ``copy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import free_name, name, sheltered, spool

WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2
SEED = "mix-1"
#: Rows of the table of tasks and sources, some 100 bytes each, up to which Spark may send it to every task.
SENT = 50_000


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def uniform(digest: Column) -> Column:
    """A number from 0 up to 1 by the first eight hex digits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """Adds each source's target and offset. sources: one row each with gl_source, gl_null, source_size.

    The table of sources is an aggregate with one row a source; ordering it is the only step in one task.
    """
    everywhere = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everywhere.orderBy("gl_null", "gl_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    # sources fill up in the order of most / weight; before the k-th is full, the level is what is left by what weight is left
    filling = everywhere.orderBy(F.col("most") / F.col("weight"), "gl_null", "gl_source").rowsBetween(Window.unboundedPreceding, -1)
    full, gone = F.coalesce(F.sum("most").over(filling), F.lit(0)), F.coalesce(F.sum("weight").over(filling), F.lit(0))
    total, all_weight = F.sum("source_size").over(everywhere), F.sum("weight").over(everywhere)
    out = out.withColumn("level", (total * F.lit(budget) - full) / (all_weight - gone))
    open_ = F.col("weight") * F.col("level") <= F.col("most")
    level = F.coalesce(F.min(F.when(open_, F.struct(F.col("most") / F.col("weight"), "gl_null", "gl_source", "level"))).over(everywhere)["level"], F.lit(float("inf")))
    # a source without words has nothing to take, at any level
    target = F.when(F.col("most") == 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * level, F.col("most").cast("double")))
    offset = uniform(F.md5(F.concat(F.lit(SEED + ":"), F.when(F.col("gl_null"), F.lit("-")).otherwise(F.lit("+")), F.col("gl_source"))))
    return out.select("gl_source", "gl_null", "source_size", target.alias("target"), offset.alias("offset"))


def drawn(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The columns ``keep``, gl_size, gl_source_size, gl_target and gl_copies."""
    src = name(source)
    order = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(name(key).cast("string"), F.lit(""))))
    rows = docs.select(*map(name, keep), F.coalesce(src, F.lit("")).alias("gl_source"), src.isNull().alias("gl_null"), words(name(text)).alias("gl_size"), order.alias("gl_order"), name(key).alias("gl_key"))
    order = [*(at := ["gl_source", "gl_null"]), "gl_size", "gl_order", "gl_key"]
    # the number of a row tells its task and its place there, where rows are in order
    ranged = spool(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gl_id", F.monotonically_increasing_id())
    placed = spool(ranged.select("*", F.shiftright("gl_id", 33).alias("gl_task")).drop("gl_order", "gl_key"))
    starts = placed.groupBy("gl_task", *at).agg(F.min("gl_id").alias("gl_start"), F.count("*").alias("gl_n"), F.sum("gl_size").alias("gl_words"))
    starts = spool(starts)
    sources = targets(starts.groupBy(*at).agg(F.sum("gl_words").alias("source_size")))
    before = Window.partitionBy(*at).orderBy("gl_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.withColumn("gl_before", F.coalesce(F.sum("gl_n").over(before), F.lit(0))).join(sources, at).drop("gl_n", "gl_words")
    out = placed.join(F.broadcast(offsets) if starts.count() <= SENT else offsets, ["gl_task", *at])
    rank = F.col("gl_before") + F.col("gl_id") - F.col("gl_start")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    copies = F.floor((rank + 1) * rate + F.col("offset")) - F.floor(rank * rate + F.col("offset"))
    return out.select(*map(name, keep), "gl_size", F.col("source_size").alias("gl_source_size"), F.col("target").alias("gl_target"), copies.cast("long").alias("gl_copies"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: its size, its source's size and target, and the words that the mix takes of it."""
    out = drawn(docs, ["doc_id"], **options)
    return out.select("doc_id", F.col("gl_size").alias("size"), F.col("gl_source_size").alias("source_size"), F.col("gl_target").alias("target"), (F.col("gl_copies") * F.col("gl_size")).alias("taken"))


@sheltered
def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents as often as the mix takes them, with the column copy from 1 (copy_1 where documents have a copy).

    Texts move once, to meet their copies by ``key``; where keys are null or repeat, the rows are numbered and
    written down first, and the numbers meet instead.
    """
    added = free_name("copy", docs.columns)
    n, distinct = docs.select(name(key).alias("k")).agg(F.count("*"), F.count_distinct("k")).first()
    row = key
    if n != distinct:
        docs, row = spool(docs.withColumn("gl_row", F.monotonically_increasing_id())), "gl_row"
    taken = drawn(docs, [row], key=key, **options).where("gl_copies > 0").select(name(row).alias("gl_taken"), "gl_copies")
    # the copies are as many rows as the documents: one plan at every size
    out = docs.join(spool(taken).hint("merge"), name(row) == F.col("gl_taken"))
    out = out.withColumn(added, F.explode(F.sequence(F.lit(1).cast("long"), F.col("gl_copies"))))
    return out.drop("gl_row", "gl_taken", "gl_copies")
