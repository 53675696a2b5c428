"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts.

One Arrow pass makes the fingerprints; documents with equal ones are one row from
then on.  Two fingerprints within ``RADIUS`` bits agree on one of ``RADIUS`` + 1 parts of
their bits, so only those that share a part are laid out in tiles: sorted by bit
count, cut in tiles, and every tile pair whose bit counts can lie within the radius is
compared whole in numpy.  Tile pairs beyond it are skipped.  A part that more than
``TILE_ROWS`` fingerprints share is split over several tasks, each of which compares two
blocks of them; no pair is lost.

A task returns a spanning forest of the links it finds, so rows stay linear in the
number of fingerprints however dense the links are.  Components come from rounds of
large-star and small-star steps over those links, each written to the shared folder.

Defined results: a text without words has fingerprint zero, linked like any other; so
has a null text; a null doc_id is no candidate for the smallest id; repeated rows get
one row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import RESULT, SPACE_TABLE, annotate, discard, name, raw_texts, sheltered, spool

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE, TILE_ROWS = 512, 8192
#: Members of a set of which a fingerprint says little.
FEW = 12
_BITS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: bit by bit the majority over its shingles' hashes."""
    words = text.translate(SPACE_TABLE).split()
    if not words:
        return 0
    # shingles are stretches of the words joined by spaces
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -shingle] + 1]
    digest = xxhash.xxh64_intdigest
    bounds = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in bounds), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set where over half of them have it set."""
    total = np.zeros(_BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed number."""

    def start():
        def work(column):
            found = np.array([fingerprint(x, shingle) for x in raw_texts(column)], np.uint64)
            return {"fp": pa.array(found.view(np.int64))}

        return work

    return annotate(docs, start, "fp long", [text], keep).select(*map(name, keep), F.col(f"{RESULT}.fp").alias("fp"))


def parts(radius: int = RADIUS) -> list[tuple[int, int]]:
    """Shift and mask of the radius + 1 parts of the bits."""
    edges = [_BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a - b: every node gets the smallest label that it reaches."""
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label != label[label]).any():
            label = label[label]
    return label


def linked(values: np.ndarray, block: np.ndarray, across: bool, radius: int = RADIUS, tile: int = TILE, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius, as (root, member).

    values: fingerprints; ``across``: only pairs of different blocks are asked for.  ``sizes``, of the fingerprinted sets: only
    pairs are asked for of which the smaller has 4/5 of the larger's size at least, and those with ``FEW`` members are
    all linked, since so few say little.
    """
    counts = np.bitwise_count(values).astype(np.int16)
    order = np.lexsort((values, counts))
    values, counts, block = values[order], counts[order], block[order]
    few = np.zeros(len(values), bool)
    if sizes is not None:
        sizes = sizes[order]
        few = sizes <= FEW
    reach = _BITS if few.any() else radius
    n = len(values)
    label = np.arange(n)
    for i in range(0, n, tile):
        u, last = values[i : i + tile], counts[min(i + tile, n) - 1]
        # bit counts rise over the tiles: the first tile beyond the radius ends the row of tiles
        for j in range(i, n, tile):
            if counts[j] - last > reach:
                break
            v = values[j : j + tile]
            near = np.bitwise_count(u[:, None] ^ v[None, :]) <= radius
            if sizes is not None:
                x, y = sizes[i : i + tile, None], sizes[None, j : j + tile]
                near |= few[i : i + tile, None] & few[None, j : j + tile]
                near &= 5 * np.minimum(x, y) >= 4 * np.maximum(x, y)
            if across:
                near &= block[i : i + tile, None] != block[None, j : j + tile]
            a, b = np.nonzero(near)
            if i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                label = _joined(label, a + i, b + j)
    member = np.flatnonzero(label != np.arange(n))
    return list(zip(order[label[member]].tolist(), order[member].tolist(), strict=True))


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links u < v between fingerprints (column fp, distinct) that connect all within the radius."""
    # unsigned parts of the signed number
    keys = F.array(*(F.struct(F.lit(k).cast("long").alias("part"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m)).alias("key")) for k, (s, m) in enumerate(parts(radius))))
    laid = distinct.select(F.col("fp").alias("id"), F.explode(keys).alias("k")).select("id", "k.part", "k.key")
    return in_groups(laid, None, radius, tile_rows)


def crowded(laid: DataFrame) -> DataFrame:
    """part, key and n, their number, of groups of two and more."""
    return laid.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")


def in_groups(laid: DataFrame, about: DataFrame | None, radius: int, tile_rows: int = TILE_ROWS, several: DataFrame | None = None) -> DataFrame:
    """Links u < v that connect all fingerprints of a group within the radius; see linked() for sizes.

    laid: id, part and key, one row for each group, told by part and key, that a fingerprint is in; about: id, fp and size,
    or None where the id is the fingerprint; several: of ``crowded``, where it is known already.
    A group of more than ``tile_rows`` is split into blocks, and each pair of blocks is compared by a task.
    """
    # only groups that several share are compared; large ones get more blocks
    met = laid.join(crowded(laid) if several is None else several, ["part", "key"])
    n_blocks = F.ceil(F.col("n") / (tile_rows // 2))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    pair = F.struct("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    met = met.join(about, "id") if about is not None else met.select("*", F.col("id").alias("fp"), F.lit(None).cast("long").alias("size"))
    rows = met.select("id", "fp", F.xxhash64(pair).alias("task"), "own", (F.col("own") != F.col("other")).alias("across"), "key", "part", "size")
    dealt = rows.repartition("task").sortWithinPartitions("task", "part", "key", "across", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                # all but the last task of what is held is whole; its first row may lie several batches back
                if sum(b.num_rows for b in held) >= 4 * tile_rows:
                    last = batch.column(2)[-1].as_py()
                    for k in reversed(range(len(held))):
                        others = np.flatnonzero(held[k].column(2).to_numpy() != last)
                        if len(others):
                            cut = int(others[-1]) + 1
                            yield from compared([*held[:k], held[k].slice(0, cut)])
                            held = [held[k].slice(cut), *held[k + 1 :]]
                            break
        if held:
            yield from compared(held)

    def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([b for b in held if b.num_rows]) if any(b.num_rows for b in held) else None
        if whole is None:
            return
        ids, fp, task, own, across, key, part = (whole.column(i).to_numpy() for i in range(7))
        sizes = None if whole.column(7).null_count else whole.column(7).to_numpy()
        values = fp.astype(np.int64).view(np.uint64)
        new = (task[1:] != task[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (across[1:] != across[:-1])
        bounds = np.r_[0, np.flatnonzero(new) + 1, len(task)]
        first = bounds[:-1][np.diff(bounds) == 2]
        # groups of two, all at once
        near = np.bitwise_count(values[first] ^ values[first + 1]) <= radius
        if sizes is not None:
            x, y = sizes[first], sizes[first + 1]
            near = (near | (np.maximum(x, y) <= FEW)) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
        near &= ~(across[first].astype(bool) & (own[first] == own[first + 1]))
        out = [(int(a), int(a) + 1) for a in first[near]]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 2:
                out += [(a + x, a + y) for x, y in linked(values[a:b], own[a:b], bool(across[a]), radius, sizes=None if sizes is None else sizes[a:b])]
        if out:
            at = np.array(out)
            u, v = ids[at[:, 0]], ids[at[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").where("u < v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links, by large-star and small-star steps."""
    edges = spool(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    before = None
    for _ in range(rounds):
        former, edges = edges, spool(_small_star(_large_star(edges)))
        discard(former)
        # the links are stars when every member has one root and no root is a member
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest neighbour (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    out = edges.join(least, "v")
    return out.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def classes(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """fp, root (a fingerprint) and component_id, the smallest id of all documents whose fingerprints are reachable.

    prints: key and fp, one row a document.
    """
    distinct = spool(prints.groupBy("fp").agg(F.min(name(key)).alias("first")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: its fingerprint in hex and the smallest doc_id reachable."""
    prints = spool(fingerprints(docs, ["doc_id"], **options))
    out = prints.join(classes(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@sheltered
def deduplicated(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One document of each component, the one with the smallest id; its columns as they were.

    Only ids and fingerprints are compared.  Texts move once, to meet the ids that stay; where ids are null or
    repeat, the rows are numbered and written down first, and the numbers meet instead.
    """
    n, distinct = docs.select(name(key).alias("k")).agg(F.count("*"), F.count_distinct("k")).first()
    row = key
    if n != distinct:
        docs, row = spool(docs.withColumn("gl_row", F.monotonically_increasing_id())), "gl_row"
    prints = spool(fingerprints(docs, list(dict.fromkeys([key, row])), **options))
    first = F.struct(name(key).isNull().alias("none"), name(key).alias("key"), name(row).alias("row"))
    stay = prints.join(classes(prints, key), "fp").groupBy("root").agg(F.min(first)["row"].alias("gl_stay"))
    out = docs.join(stay.select("gl_stay"), name(row) == F.col("gl_stay"), "left_semi")
    return out.drop("gl_row") if n != distinct else out
