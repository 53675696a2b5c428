"""How filters interact: what each removes in every order of them, by a packed bitmap index.

The index has one row a block of documents of one task: a bit a document for each filter (set where the document fails
it), for each label, and for each part of the corpus.  A block's rows are sorted by part, so a part's bits are kept only
from the byte where they begin to the one where they end, and many parts take no more room than few.

What is left after the filters of a set is the same in whatever order they came.  So an order's figures follow from the
counts of what each of its prefixes leaves: for every set of filters, each part's bits AND NOT the bits of each filter in
the set, then the ones are counted, alone and among each label.  Blocks give counts, a part's counts are summed over all
blocks, and all orders are read from the sums: 2^F counts a part and not F! passes.

Defined results: a null text is empty; words are stretches without white space; an empty text fails the rule on words and
no other, but for being a copy; a null doc_id is nobody's smaller id and has none; of rows with one id and text none is the
other's copy; a document with several labels has those that any of its label rows gives; a document without labels is
counted, and neither good nor toxic; a null part is the empty string's; very long texts are read whole; an empty table
gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import RESULT, annotate, name, raw_texts, spool

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
LABELS = {"good": ("quality", 1), "toxic": ("toxic", 1)}
#: Documents in a block of the index.
BLOCK = 1 << 16
_CAPITALS = bytes(range(0x41, 0x5B))
_MARKS = re.compile(rb"[#$%&*|]")
_LOWER = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_TAILS = bytes(range(0x80, 0xC0))


def conditions(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a UTF-8 text fails A (few words), B (few distinct words), C (many capitals), D (a mark)."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _TAILS)))
    capitals = len(text.translate(None, _LOWER))
    return len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words), 100 * capitals > MAX_CAPITALS * points, _MARKS.search(text) is not None


def judged(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id", marks: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """One row a document: part, the bits of the filters that it fails (the first filter's is 1), and of its labels.

    Texts are read once, without a shuffle; what moves is an id, a digest and the bits.  marks: a label's column and value.
    """
    marks = LABELS if marks is None else marks

    def start():
        def work(column):
            fails, digests = [], []
            for x in raw_texts(column):
                fails.append(sum(bit << k for k, bit in enumerate(conditions(x))))
                digests.append(hashlib.sha256(x).digest())
            return {"fails": fails, "digest": digests}

        return work

    # one name more than the key, since the key may bear the part's
    read = annotate(docs.select(name(key).alias("k"), F.coalesce(name(part).cast("string"), F.lit("")).alias("part"), name(text).alias("t")), start, "fails int, digest binary", ["t"], ["k", "part"])
    seen = spool(read.select("k", "part", f"{RESULT}.fails", f"{RESULT}.digest"))
    # of a text that several documents have, the smallest id; counted before anything moves
    # (written down, so that Spark can split the join where one text is a large share of all rows)
    firsts = spool(seen.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copy = F.coalesce(F.col("k") > F.col("first"), F.lit(False)).cast("int")
    out = seen.join(firsts, "digest", "left").select("k", "part", F.col("fails").bitwiseOR(F.shiftleft(copy, 4)).alias("fails"))
    given = [F.max(F.coalesce(name(c) == v, F.lit(False)).cast("int")) for c, v in marks.values()]
    held = labels.groupBy(name(key).alias("k")).agg(sum((F.shiftleft(x, i) for i, x in enumerate(given)), F.lit(0)).alias("labels"))
    return out.join(spool(held.where("k is not null")), "k", "left").select("part", "fails", F.coalesce("labels", F.lit(0)).alias("labels"))


def index(bits: DataFrame, filters: int = len(FILTERS), labels: int = len(LABELS), block: int = BLOCK) -> DataFrame:
    """The packed bitmap index of rows with part, fails and labels; n is a block's number of documents."""
    schema = "n long, filters array<binary>, labels array<binary>, parts array<struct<part: string, start: long, bits: binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, block - sum(b.num_rows for b in held))
                held.append(head)
                batch = batch.slice(head.num_rows)
                if sum(b.num_rows for b in held) == block:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [[np.packbits(whole.column(k).to_numpy() >> i & 1).tobytes() for i in range(n)] for k, n in ((1, filters), (2, labels))]
        coded = whole.column(0).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        edges = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)].tolist()
        parts = []
        for a, b in zip(edges, edges[1:], strict=False):
            first = a // 8
            ones = np.zeros(b - 8 * first, bool)
            ones[a - 8 * first :] = True
            parts.append({"part": coded.dictionary[int(codes[a])].as_py(), "start": first, "bits": np.packbits(ones).tobytes()})
        kind = pa.struct([("part", pa.string()), ("start", pa.int64()), ("bits", pa.binary())])
        arrays = [pa.array([whole.num_rows]), *(pa.array([x], pa.list_(pa.binary())) for x in columns), pa.array([parts], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "filters", "labels", "parts"])

    return bits.sortWithinPartitions("part").mapInArrow(run, schema)


def left(index: DataFrame, filters: int = len(FILTERS), labels: int = len(LABELS)) -> DataFrame:
    """Each part's counts of the documents that fail no filter of a set: part, and n, an array of arrays by set (a filter's
    bit in it is its place's), each with the count of all documents and of those with each label."""
    sets = 1 << filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                fails, marks = ([np.frombuffer(x, np.uint8) for x in row[c]] for c in ("filters", "labels"))
                for p in row["parts"]:
                    own = np.frombuffer(p["bits"], np.uint8)
                    at = slice(p["start"], p["start"] + len(own))
                    held = counts.setdefault(p["part"], np.zeros((sets, 1 + labels), np.int64))
                    # a set's survivors are those of the set without its highest filter, AND NOT that filter
                    alive = [own]
                    for s in range(1, sets):
                        high = s.bit_length() - 1
                        alive.append(alive[s ^ 1 << high] & ~fails[high][at])
                    for s, bits in enumerate(alive):
                        held[s] += [int(np.bitwise_count(bits & x).sum(dtype=np.int64)) for x in (np.uint8(255), *(m[at] for m in marks))]
        if counts:
            flat = pa.array(np.concatenate([x.ravel() for x in counts.values()]))
            keys = np.tile(np.arange(sets * (1 + labels)), len(counts))
            names = pa.array(list(counts)).take(pa.array(np.repeat(np.arange(len(counts)), sets * (1 + labels))))
            yield pa.RecordBatch.from_arrays([names, pa.array(keys), flat], names=["part", "at", "n"])

    summed = index.mapInArrow(run, "part string, at long, n long").groupBy("part", "at").agg(F.sum("n").alias("n"))
    counted = summed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n"))
    each = f"transform(sequence(0, {sets - 1}), s -> transform(sequence(0, {labels}), k -> n[bigint(s * {1 + labels} + k)]))"
    return counted.select("part", F.expr(each).alias("n"))


def orders(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: its filter, and the sets of filters before and after it."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append({"filter_order": "".join(filters[i] for i in order), "step": step, "k": k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    return out


def audit(counts: DataFrame, filters: str = FILTERS, lost: tuple[str, ...] = ("good_lost", "toxic_lost")) -> DataFrame:
    """One row for each part, order and step from the counts of ``left``; ``lost`` names the columns of the labels."""
    whole, others = (1 << len(filters)) - 1, len(filters) - 1
    steps = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order: string, step: int, k: int, before: int, after: int>>")

    def removed(s: int, k: int) -> str:
        return f"(n[{s}][0] - n[{s | 1 << k}][0])"

    def shapley(k: int) -> str:
        # a set stands before the filter in as many orders as there are of it and of the rest
        return " + ".join(f"{factorial(s.bit_count()) * factorial(others - s.bit_count())} * {removed(s, k)}" for s in range(whole + 1) if not s >> k & 1)

    def own(of: Callable[[int], str]) -> str:
        return f"array({', '.join(of(k) for k in range(len(filters)))})[k]"

    gone = "n[before][0] - n[after][0]"
    return counts.select("part", "n", F.explode(steps).alias("s")).select("part", "n", "s.*").selectExpr(
        "part", "filter_order", "step", "n[after][0] AS kept", f"{gone} AS removed", f"{own(lambda k: removed(0, k))} - ({gone}) AS redundant", f"{own(lambda k: removed(whole ^ 1 << k, k))} AS unique_fails",
        *(f"n[before][{i}] - n[after][{i}] AS {c}" for i, c in enumerate(lost, 1)), f"{own(shapley)} AS shapley",
    )


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(left(spool(index(judged(docs, labels, **options)))))
