"""Ranked lexical search: the documents that score highest for each item, by impact-ordered score-at-a-time.

A term's weight in a score is whole and an occurrence's impact is weight times a whole number, so impacts are exact and
postings can be grouped by them.  One Arrow pass over the texts finds each document's number of terms and, of the terms
that items hold, those in it with their numbers; these postings are written down, since impacts need the counts of the
whole corpus (documents, terms, documents by term), which are summed from them.  Then every task lays out the postings of
a block of documents by term in descending order of impact, and works on one item at a time: the groups of equal impact
of all its terms are taken in descending order, and added up by document.  It stops once no document outside the best k
can reach them any more, whatever the rest of the postings hold; the scores of the best k are then completed from the
documents' own postings.  A task carries its best k of each item from block to block, as a bound to begin with; Spark
ranks the tasks' best.

Items are looked up by all documents, so their terms go to every task: a block of items, at most ``ITEM_BYTES`` of text, at a
time (larger texts alone), and for each block the texts are read once.

Defined results: a null or empty document has no terms and is found by nothing; a null or empty item finds nothing; documents
of equal scores stand by ascending id, a null id last; repeated rows are found one by one, and so each row of an item that
comes twice has its own list; very long texts are read whole; an empty table of either kind gives no rows; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import ALNUM_TABLE, RESULT, annotate, name, raw_texts, spool

TOP = 50
#: Text of items whose terms are sent to tasks at once.
ITEM_BYTES = 4 << 20
#: Postings that a task lays out at once, and postings of an item that are added up between two looks at the bound.
POSTINGS, STEP = 2_000_000, 4096
SCALE, RATE, BASE, SLOPE = 1_000_000_000, 20, 50, 50


def term_counts(texts: list[bytes], known: pa.Array) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Each text's number of terms, and its terms (by their numbers in ``known``, ascending) with their numbers of occurrences."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    # a space ends every text, so no term spans two
    data = np.frombuffer(b" ".join([*texts, b""]).translate(ALNUM_TABLE), np.uint8)
    inside = data != 0x20
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, stop = edge[::2], edge[1::2]
    owner = np.searchsorted(ends, begin, "right")
    n = np.bincount(owner, minlength=len(texts))
    at = np.r_[0, np.cumsum(stop - begin)]
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    number = pc.index_in(words, known)
    held = np.flatnonzero(pc.is_valid(number).to_numpy(zero_copy_only=False))
    pair, tf = np.unique(owner[held] * max(1, len(known)) + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
    doc, term = np.divmod(pair, max(1, len(known)))
    cut = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    return n, pa.ListArray.from_arrays(cut, term.astype(np.int32)), pa.ListArray.from_arrays(cut, tf)


def item_terms(text: str | None) -> list[bytes]:
    """The distinct terms of an item."""
    return sorted(set((text or "").encode().translate(ALNUM_TABLE).split()))


def weight(n: int, df: int) -> int:
    """A term's weight, of ``n`` documents with terms of which ``df`` hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What occurrences add to scores, in whole numbers."""
    m = 100 - BASE + (SLOPE * n * documents) // max(1, terms)
    return weights * ((SCALE * tf) // (1000 * tf + RATE * m))


class Block:
    """The postings of some documents: by document as they came, and by term in descending order of impact."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.size, self.term, self.impact = size, term, impact
        self.starts = np.searchsorted(doc, np.arange(size + 1))
        order = np.lexsort((doc, -impact, term))
        self.by_term, self.doc, self.value = term[order], doc[order], impact[order]

    def postings(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Documents and impacts, descending, of those of the terms that have any."""
        bounds = zip(np.searchsorted(self.by_term, terms), np.searchsorted(self.by_term, terms, "right"), strict=True)
        return [(self.doc[a:b], self.value[a:b]) for a, b in bounds if a < b]

    def best(self, terms: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of the highest scores above 0, none below ``least``, and their scores; of equal ones, the first come first.

        terms: an item's, ascending.
        """
        lists = self.postings(terms)
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(lists)), [len(v) for _, v in lists])
        doc, value = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
        order = np.argsort(-value, kind="stable")
        of, doc, value = of[order], doc[order], value[order]
        # what the rest of a list can add to one document is at most the impact of its next group
        rest = np.array([v[0] for _, v in lists])
        taken = np.zeros(len(lists), np.int64)
        score = np.zeros(self.size, np.int64)
        step, at = STEP, 0
        while at < len(value):
            # whole groups of equal impact only
            stop = min(at + step, len(value))
            stop += int(np.searchsorted(-value[stop:], -value[stop - 1], "right"))
            np.add.at(score, doc[at:stop], value[at:stop])
            taken += np.bincount(of[at:stop], minlength=len(lists))
            at, step = stop, 2 * step
            if at == len(value):
                break
            rest = np.array([v[t] if t < len(v) else 0 for (_, v), t in zip(lists, taken.tolist(), strict=True)])
            open_ = int(rest.sum())
            if self.size <= k:
                continue
            # the k-th best so far, or what other blocks have shown, and the best of the others
            parted = np.partition(score, self.size - k - 1)
            bar = max(int(parted[self.size - k :].min()), least)
            if parted[: self.size - k].max() + open_ < bar:
                break
        return self.completed(score, terms, k, least, int(rest.sum()) if at < len(value) else 0)

    def completed(self, score: np.ndarray, terms: np.ndarray, k: int, least: int, open_: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k from what was added up; scores that may lack something are completed from the documents' own postings."""
        bar = np.partition(score, self.size - k)[self.size - k] if self.size > k else 0
        chosen = np.flatnonzero((score >= max(bar, 1)) & (score + open_ >= least))
        whole = score[chosen]
        if open_:
            whole = np.array([self.impact[a:b][np.isin(self.term[a:b], terms)].sum() for a, b in zip(self.starts[chosen], self.starts[chosen + 1], strict=True)], np.int64)
        stay = whole >= max(least, 1)
        chosen, whole = chosen[stay], whole[stay]
        order = np.lexsort((chosen, -whole))[:k]
        return chosen[order], whole[order]


def counted(docs: DataFrame, known: list[bytes], key: str, text: str) -> DataFrame:
    """One row a document with terms: k, n, and those of ``known`` in it, term and tf. known is sent to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def start():
        terms = pa.array(sent.value, pa.large_binary())

        def work(column):
            n, term, tf = term_counts(raw_texts(column), terms)
            return {"n": n, "term": term, "tf": tf}

        return work

    read = annotate(docs.select(name(key).alias("k"), name(text).alias("t")), start, "n long, term array<int>, tf array<long>", ["t"], ["k"])
    return read.select("k", f"{RESULT}.*").where("n > 0")


def documents_by_term(postings: DataFrame, size: int) -> list[int]:
    """How many documents hold each of the ``size`` terms; summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])

    out = [0] * size
    for term, df in postings.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def found(docs: DataFrame, asked: list[tuple[int, list[bytes]]], top: int, key: str, text: str) -> DataFrame:
    """row, k and score of the best documents of each item of ``asked``, at most ``top`` from every task."""
    spark = docs.sparkSession
    known = sorted(set().union(*(terms for _, terms in asked)))
    postings = spool(counted(docs, known, key, text))
    documents, terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    number = {t: i for i, t in enumerate(known)}
    queries = [(row, np.array([number[t] for t in own], np.int64)) for row, own in asked]
    sent = spark.sparkContext.broadcast((np.array([weight(documents, df) for df in documents_by_term(postings, len(known))], np.int64), queries))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = sent.value
        best: dict[int, tuple[pa.Array, np.ndarray]] = {}
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                held.append(batch.slice(k, 256))
                if sum(len(b.column(2).flatten()) for b in held) >= POSTINGS:
                    scored(held, weights, queries, best)
                    held = []
        if held:
            scored(held, weights, queries, best)
        task = TaskContext.get().partitionId()
        for row, (ids, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), row)), ids, pa.array(score), pa.array(np.full(len(score), task))], names=["row", "k", "score", "task"])

    def scored(held: list[pa.RecordBatch], weights: np.ndarray, queries: list, best: dict) -> None:
        whole = pa.Table.from_batches(held)
        # documents in ascending order of their ids, nulls last: of equal scores the first come first
        whole = whole.take(pc.sort_indices(whole, sort_keys=[("k", "ascending")], null_placement="at_end")).combine_chunks()
        term = whole.column("term").combine_chunks()
        sizes = pc.list_value_length(term).to_numpy()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = term.flatten().to_numpy().astype(np.int64), whole.column("tf").combine_chunks().flatten().to_numpy()
        block = Block(len(sizes), doc, term, impacts(weights[term], tf, whole.column("n").to_numpy()[doc], documents, terms))
        ids = whole.column("k").combine_chunks()
        for row, own in queries:
            former = best.get(row)
            least = int(former[1][-1]) if former and len(former[1]) == top else 0
            at, score = block.best(own, top, least)
            if not len(at):
                continue
            near = ids.take(pa.array(at))
            if former:
                near, score = pa.concat_arrays([former[0], near]), np.r_[former[1], score]
                ranked = pa.table({"s": score, "k": near})
                order = pc.sort_indices(ranked, sort_keys=[("s", "descending"), ("k", "ascending")], null_placement="at_end").slice(0, top)
                near, score = near.take(order), score[order.to_numpy()]
            best[row] = near, score

    return postings.mapInArrow(run, f"row long, k {kind}, score long, task long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", limit: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank from 1, doc_id and score of the ``top`` documents of each item; all that score above 0, if they are fewer."""
    spark = docs.sparkSession
    content = F.coalesce(name(text), F.lit(""))
    numbered = spool(items.select(F.monotonically_increasing_id().alias("row"), name(item).alias("item"), content.alias("text")))
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # blocks of half the limit, so that none goes beyond it but by a single text
    blocks = 1 + 2 * size // limit
    parts = []
    for b in range(blocks):
        mine = numbered.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        asked = [(r["row"], item_terms(r["text"])) for r in mine.select("row", "text").collect()]
        if any(own for _, own in asked):
            parts.append(spool(found(docs, asked, top, key, text)))
    best = parts[0] if parts else spark.createDataFrame([], f"row long, k {docs.schema[key].dataType.simpleString()}, score long, task long")
    for more in parts[1:]:
        best = best.unionByName(more)
    by = [F.desc("score"), F.col("k").asc_nulls_last()]
    # the best of some tasks first: an item's rows from all tasks need not fit one
    some = best.withColumn("place", F.row_number().over(Window.partitionBy("row", F.pmod("task", F.lit(64))).orderBy(*by))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*by))).where(F.col("rank") <= top)
    return ranked.join(numbered.select("row", "item"), "row").select(F.col("item").alias("item_id"), "rank", F.col("k").alias("doc_id"), "score")


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Each item's documents of the highest scores."""
    return search(docs, items, **options)
