"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.storage import discard, spool


def connected(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """node and component, the smallest node reachable, for all ends of the edges (a, b) and all ``nodes``.

    Alternating large-star and small-star steps: every step aggregates a minimum per node, so a node of any degree
    is combined before it is shuffled, and the number of rounds grows with the logarithm of the longest path.
    """
    pairs = spool(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        former = pairs
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v")
        pairs = spool(moved.unionByName(low.select(F.col("m").alias("u"), "v")).distinct())
        discard(former)
        state = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    every = (ends if nodes is None else ends.union(nodes.select("node"))).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def sheet_edges(references: DataFrame, sheets: DataFrame) -> DataFrame:
    """file, src, dst, n: references (file, src, dst, n) to other sheets that the file has (file, name)."""
    known = sheets.select("file", F.col("name").alias("dst")).distinct()
    used = references.where("src <> dst").groupBy("file", "src", "dst").agg(F.sum("n").alias("n"))
    return used.join(known, ["file", "dst"], "left_semi").select("file", "src", "dst", "n")


def degrees(edges: DataFrame, sheets: DataFrame) -> DataFrame:
    """file, name, reads, read_by: sorted arrays for every sheet."""
    out = edges.groupBy("file", F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("reads"))
    back = edges.groupBy("file", F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("read_by"))
    none = F.array().cast("array<string>")
    joined = sheets.select("file", "name").distinct().join(out, ["file", "name"], "left").join(back, ["file", "name"], "left")
    return joined.select("file", "name", F.coalesce("reads", none).alias("reads"), F.coalesce("read_by", none).alias("read_by"))
