"""Benchmark decontamination with suffix arrays over the training text.

Every task takes its documents in shards of a few MB, turns words into numbers, and
sorts all suffixes of a shard (prefix doubling, so repetition costs no more than a
logarithm).  The windows of all benchmark items are binary-searched in that suffix array;
what is found are the places of verbatim matches.  Each place is then followed to the
longest match that any benchmark suffix has there.  A suffix of the training text ends
at a word that no item of the block has: no match can cross it.  Nothing is shuffled.

The benchmark is the query set and is taken in blocks of about ``block_bytes`` of
distinct items (an item longer than that is in one block).  One block is on the driver and
in a task at a time: with several, each has a job of its own over the documents, and only
its finds are kept, in the shared folder.

The benchmark is counted and read by actions that run while the result is built.

Stretches of words are compared by two 31-bit polynomial hashes, so two different ones
are taken as equal with a chance of about 2^-62 each.

Defined results: a null or empty text has no words and is clean; a very long text is
searched whole; an item without words has no window; a null item_id is listed as an empty
string; equal item_ids are listed once; repeated documents are judged one by one; an empty
benchmark finds nothing, and no documents give no rows; ``decontaminated`` returns all
columns as they were, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ALNUM_TABLE, RESULT, annotate, name, offsets, raw_texts, sheltered, spool

WINDOW = 10
BLOCK_BYTES = 4 << 20
_FIELDS = "n_words long, hits array<struct<start:long,end:long>>, items array<string>, longest_match long"
#: Moduli and bases of the hashes.
_PRIMES, _BASES = (2147483647, 2147483629), (1000003, 1618033)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased words `[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+` of UTF-8 bytes."""
    return text.translate(ALNUM_TABLE).split()


class Text:
    """Numbered words, a zero after each text, with what comparing stretches of them needs."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        places = np.where(ids == 0, np.arange(len(ids)), len(ids))
        #: words from each place to the next zero
        self.left = np.minimum.accumulate(places[::-1])[::-1] - np.arange(len(ids))
        self._hashes: list[tuple[np.ndarray, np.ndarray]] | None = None

    def hashes(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each modulus: powers of its base, and prefix sums of words times powers."""
        if self._hashes is None:
            self._hashes = []
            for prime, base in zip(_PRIMES, _BASES, strict=True):
                power = np.ones(len(self.ids) + 1, np.int64)
                done = 1
                while done < len(power):
                    step = min(done, len(power) - done)
                    power[done : done + step] = power[:step] * pow(base, done, prime) % prime
                    done += step
                self._hashes.append((power, np.r_[0, np.cumsum(self.ids % prime * power[:-1] % prime)]))
        return self._hashes


def equal(x: Text, a: np.ndarray, y: Text, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Are the next ``length`` words of x from a those of y from b?"""
    out = np.ones(len(a), bool)
    for prime, (px, hx), (_, hy) in zip(_PRIMES, x.hashes(), y.hashes(), strict=True):
        far = px if len(px) >= len(y.ids) + 1 else y.hashes()[_PRIMES.index(prime)][0]
        u, v = (hx[a + length] - hx[a]) % prime, (hy[b + length] - hy[b]) % prime
        out &= u * far[b] % prime == v * far[a] % prime
    return out


def common(x: Text, a: np.ndarray, y: Text, b: np.ndarray) -> np.ndarray:
    """How many words x from a and y from b have in common."""
    low, high = np.zeros(len(a), np.int64), np.minimum(x.left[a], y.left[b])
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = equal(x, a, y, b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def heads(ids: np.ndarray, at: np.ndarray, k: int, base: int) -> np.ndarray:
    """The first k words at each place as one number, zeros after a zero."""
    out, live = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j in range(k):
        word = np.where(live, ids[np.minimum(at + j, len(ids) - 1)], 0)
        live &= word > 0
        out = out * base + word
    return out


def suffix_order(text: Text, at: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their suffixes, and their first k words as numbers, in that order.

    Suffixes are ranked by k words, then, while some are tied, by twice as many each time: the rank of a place and
    that of the place so many words on. ``at`` holds every place that a suffix from another of them goes through.
    """
    key = heads(text.ids, at, k, base)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    index = np.arange(len(at))
    rank = np.zeros(len(text.ids) + 1, np.int64)
    own = np.maximum.accumulate(np.where(fresh, index, 0)) + 1
    rank[at] = own
    depth = k
    while True:
        # equal suffixes that have ended stay tied
        tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]) & (text.left[at] > depth))
        if not len(tied):
            return at, key
        # within a group those that have ended come first already: their next rank is the end's
        group = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        place = at[group]
        going = text.left[place] > depth
        following = np.where(going, rank[np.minimum(place + depth, len(text.ids))], 0)
        inner = np.lexsort((following, own[group]))
        at[group], following = place[inner], following[inner]
        mine = own[group]
        new = np.r_[True, (mine[1:] != mine[:-1]) | (following[1:] != following[:-1])]
        fresh[group] = new
        own[group] = group[np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))] + 1
        rank[at[group]] = own[group]
        depth *= 2


class Windows:
    """The windows of a block of benchmark items, in the order of the suffixes that they begin."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocabulary = window, {}
        self.items = sorted({x for x, _ in items})
        place = {x: i for i, x in enumerate(self.items)}
        parts, starts, owners, lengths, total = [], [], [], [], 0
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                n = max(1, len(ids) - window + 1)
                starts.append(total + np.arange(n))
                owners.append(np.full(n, place[item]))
                lengths.append(np.full(n, min(window, len(ids))))
                parts.append(np.array([*ids, 0], np.int64))
                total += len(ids) + 1
        self.text = Text(np.concatenate([*parts, np.zeros(1, np.int64)]))
        #: words that fit in one number, and the base of such numbers
        self.base = len(self.vocabulary) + 1
        self.k = max(1, min(window, int(62 // max(1.0, np.log2(self.base + 1)))))
        none = np.zeros(0, np.int64)
        at, owners, lengths = (np.concatenate([none, *x]) for x in (starts, owners, lengths))
        self.at = at
        if not len(at):
            return
        every = np.flatnonzero(self.text.ids)
        ranked, _ = suffix_order(self.text, every, self.k, self.base)
        rank = np.zeros(len(self.text.ids), np.int64)
        rank[ranked] = np.arange(len(ranked))
        order = np.argsort(rank[at], kind="stable")
        self.at, owners, lengths = at[order], owners[order], lengths[order]
        shared = common(self.text, self.at[:-1], self.text, self.at[1:])
        self.first = np.flatnonzero(np.r_[True, (lengths[1:] != lengths[:-1]) | (shared < lengths[1:])])
        self.end = np.r_[self.first[1:], len(self.at)]
        self.lengths = lengths[self.first]
        self.owned = [np.unique(owners[a:b]) for a, b in zip(self.first, self.end, strict=True)]
        #: of each distinct window the least and greatest number that its first words can begin
        held = np.minimum(self.lengths, self.k)
        own = heads(self.text.ids, self.at[self.first], self.k, self.base)
        unit = np.array([self.base**j for j in range(self.k + 1)], np.int64)[self.k - held]
        self.low = own // unit * unit
        self.high = self.low + unit - 1

    def search(self, shard: Text) -> tuple[np.ndarray, np.ndarray]:
        """The places in a shard where a window stands, and the window's number, by binary search in the shard's suffix array."""
        none = np.zeros(0, np.int64)
        if not len(self.at):
            return none, none
        at, key = suffix_order(shard, np.flatnonzero(shard.ids), self.k, self.base)
        low, high = np.searchsorted(key, self.low, "left"), np.searchsorted(key, self.high, "right")
        which = np.flatnonzero(low < high)
        # the first suffix that is not below the window, and the first that is above it
        begin = self._bound(shard, at, which, low[which], high[which], False)
        end = self._bound(shard, at, which, begin, high[which], True)
        counts = end - begin
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return at[np.repeat(begin, counts) + step], np.repeat(which, counts)

    def _bound(self, shard: Text, at: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        mine, length = self.at[self.first[which]], self.lengths[which]
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(at) - 1)
            place, same, live = at[mid], np.zeros(len(which), np.int64), low < high
            # word by word, as far as the window goes
            for j in range(int(length.max())):
                live &= (same == j) & (j < length)
                live[live] = shard.ids[np.minimum(place[live] + j, len(shard.ids) - 1)] == self.text.ids[mine[live] + j]
                same += live
            whole = same == length
            below = ~whole & (shard.ids[np.minimum(place + same, len(shard.ids) - 1)] < self.text.ids[mine + same])
            right = (low < high) & (below | whole if after else below)
            low, high = np.where(right, mid + 1, low), np.where((low < high) & ~right, mid, high)
        return low

    def extent(self, shard: Text, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Words of the longest match of any benchmark suffix at each found place."""
        low, high = self.first[which], self.end[which]
        best = self.lengths[which].copy()
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(self.at) - 1)
            mine = self.at[mid]
            same = common(shard, at, self.text, mine)
            best = np.where(open_, np.maximum(best, same), best)
            up = open_ & (self.text.ids[mine + same] < shard.ids[at + same])
            low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
        return best


def _pass(block: list[tuple[str, bytes]], window: int):
    """The Arrow function for one block; with what other blocks have found, both together."""

    def start():
        tests = Windows(block, window)
        get = tests.vocabulary.get

        def work(column, prior=None):
            before = prior.to_pylist() if prior is not None else None
            docs = [words_of(x) for x in raw_texts(column)]
            begins = offsets([len(x) + 1 for x in docs])
            ids = np.zeros(int(begins[-1]) + 1, np.int64)
            for b, ws in zip(begins.tolist(), docs, strict=False):
                ids[b : b + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
            shard = Text(ids)
            at, which = tests.search(shard)
            finds: dict[int, list] = {}
            if len(at):
                extent = tests.extent(shard, at, which)
                doc = np.searchsorted(begins, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(doc[order]) > 0, True])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    mine = order[a:b]
                    d = int(doc[mine[0]])
                    p, w = at[mine] - begins[d], which[mine]
                    names = {tests.items[i] for q in np.unique(w) for i in tests.owned[q]}
                    finds[d] = [list(zip(p.tolist(), (p + tests.lengths[w]).tolist(), strict=True)), names, int(extent[mine].max())]
            out: dict[str, list] = {"n_words": [], "hits": [], "items": [], "longest_match": []}
            for d, ws in enumerate(docs):
                spans, names, longest = finds.get(d, ([], set(), 0))
                for x in (before[d] or () if before is not None else ()):
                    spans = spans + [(s["start"], s["end"]) for s in x["hits"]]
                    names, longest = names | set(x["items"]), max(longest, x["longest_match"])
                out["n_words"].append(len(ws))
                out["hits"].append([{"start": a, "end": b} for a, b in merged(spans)])
                out["items"].append(sorted(names))
                out["longest_match"].append(longest)
            return out

        return work

    return start


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` and RESULT: n_words, hits (word spans), items (their ids) and longest_match (words)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))
    n_blocks = max(1, -(-items.agg(size.alias("n")).first()["n"] // block_bytes))

    def block(k: int) -> list[tuple[str, bytes]]:
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        return [(r["item"], r["text"].encode()) for r in rows.toLocalIterator()]

    if n_blocks == 1:
        return annotate(docs, _pass(block(0), window), _FIELDS, [text], keep)
    # a block at a time: numbered documents, each block's finds, and in the end all finds of a document
    numbered = spool(docs.select(*map(name, dict.fromkeys([*keep, text]))).withColumn("gl_row", F.monotonically_increasing_id()))
    finds = None
    for k in range(n_blocks):
        found = annotate(numbered, _pass(block(k), window), _FIELDS, [text], ["gl_row"]).where(F.size(f"{RESULT}.items") > 0)
        found = spool(found)
        finds = found if finds is None else finds.unionByName(found)
    prior = finds.groupBy("gl_row").agg(F.collect_list(RESULT).alias("gl_prior"))
    return annotate(numbered.join(prior, "gl_row", "left"), _pass([], window), _FIELDS, [text, "gl_prior"], keep)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: counts, the digest of the items found, whether it is contaminated, its longest match, and its first hit word (from 0; else null)."""
    found = find_contamination(docs, benchmark, ["doc_id"], **options)
    hit = F.aggregate(f"{RESULT}.hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col(f"{RESULT}.n_words"),
        hit.alias("n_hit"),
        F.size(f"{RESULT}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{RESULT}.items", ","), 256).alias("items_sha256"),
        (F.size(f"{RESULT}.items") > 0).alias("contaminated"),
        F.col(f"{RESULT}.longest_match"),
        F.get(F.col(f"{RESULT}.hits"), F.lit(0))["start"].alias("first_hit"),
    )


@sheltered
def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of a benchmark item stands, all their columns as they were."""
    found = find_contamination(docs, benchmark, docs.columns, **options)
    return found.where(F.size(f"{RESULT}.items") == 0).drop(RESULT)


def digest(items: list[str]) -> str:
    """The digest of a document's items, as ``report`` gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
