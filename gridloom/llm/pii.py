"""PII by bootstrapped contextual extraction.

One Arrow pass finds the base spans (emails, IP addresses, card and phone numbers:
the seed entities) and everything else that looks like an identifier (a token with ``@`` or
four digits, digit groups in a row, an address spelled out with at and dot), each with
its lexical patterns: the two words before it, the two after it, and one on either
side.  Patterns and instances form a graph, scored in rounds by Spark aggregates:
a pattern's confidence for a kind is the mean score of its distinct instances, and it is
accepted where the lower bound of that share (Wilson's, 95 %) is ``LEAST`` or more; an
instance's score is the noisy-or of its accepted patterns, seeds staying at 1.  Rounds go on
until no confidence changes, so identifiers found become seeds of further patterns.
Accepted patterns then mark the identifiers, unseen so far, that stand in them.

Scores only grow from round to round, so they settle; ``ROUNDS`` is a safety stop that raises.

Texts are read once; what is scored are hashes of tokens.  Counts per pattern and
per instance are partial sums first, so frequent ones meet as a few rows a task.
The rounds are actions that run while the result is built.

Defined results: a null or empty text has no spans; very long texts are read whole, in linear
time whatever they hold, words without an end too; an
added span never overlaps a base span; of kinds with equal confidence the later one is
taken; equal identifiers and repeated rows count as one instance in the scores and are
reported one by one; an empty table gives no rows; further columns, whatever their names, are
not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import RESULT, annotate, spool, texts

#: The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
ROUNDS, LEAST = 100, 0.5
#: Characters of a word up to which a pattern has it as it is, and from where on a number that stands for it.
LONG = 256
_STEP, _PRIME = 1_000_003, (1 << 61) - 1
_ONE_DIGIT = {ord(c): "0" for c in "123456789"}
#: The normal quantile of Wilson's bound at 95 %.
_Z = 1.96

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
# an address spelled out is looked for from its at sign, which has a local part before it and a domain after it
_AT = re.compile(r"[\[({](?:at|AT)[\])}]")
_SPELLED = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]+)+")
_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
_NUMBERS = re.compile(r"\(?(?<![0-9])[0-9]++(?:[ ().-]{1,2}[0-9]++)+")
_EDGE = "\"'()[]{}<>.,;:!?*|"
_DIGITS = re.compile(r"[0-9]+")
_SPACED = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email form, in linear time: from each ``@`` back over its local part."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        after = at + 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            after = free = m.end()
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The seed entities: leftmost non-overlapping matches of each kind that pass its check, by start and kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def spelled(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses with their at sign in brackets, in linear time: from each one back over its local part."""
    out, free, m = [], 0, _AT.search(text)
    while m:
        stop = m.start() - (m.start() > free and text[m.start() - 1] == " ")
        begin = stop
        while begin > free and text[begin - 1] in _BEFORE_AT:
            begin -= 1
        after = _SPELLED.match(text, m.end()) if begin < stop else None
        if after:
            out.append((begin, after.end()))
            free = after.end()
        m = _AT.search(text, after.end() if after else m.end())
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Further stretches that look like identifiers and overlap no base span."""
    found = [m.span() for m in _NUMBERS.finditer(text) if 7 <= sum(c.isdigit() for c in m.group()) <= 19]
    for m in _SPACED.finditer(text) if _MARKED.search(text) else ():
        a, b = m.span()
        if not _MARKED.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if "@" in text[a:b] or sum(c.isdigit() for c in text[a:b]) >= 4:
            found.append((a, b))
    if "[" in text or "(" in text or "{" in text:
        found += spelled(text)
    out, k = [], 0
    spans = sorted((a, b) for _, a, b in taken)
    end = -1
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if a >= end and not (k < len(spans) and spans[k][0] < b):
            out.append((a, b))
            end = b
    return out


class Words:
    """The words of a text by their places, for the patterns around a span."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.span() for m in _SPACED.finditer(text)]
        self.starts = [a for a, _ in self.at]
        self.sums: dict[int, list[int]] = {}

    def shown(self, a: int, b: int, word: int) -> str:
        """What a pattern has for a to b, part of a word: lower-cased, digits masked.

        Of a stretch of more than ``LONG`` characters a pattern has the length and a number that stands for it, from sums
        that are made once a word: however many spans one word holds, the work stays linear.
        """
        if b - a <= LONG:
            return _DIGITS.sub("0", self.text[a:b].lower())
        first, last = self.at[word]
        if word not in self.sums:
            plain = self.text[first:last].translate(_ONE_DIGIT)
            self.sums[word] = list(accumulate(map(ord, plain), lambda h, c: (h * _STEP + c) % _PRIME, initial=0))
        sums = self.sums[word]
        return f"{b - a} {(sums[b - first] - sums[a - first] * pow(_STEP, b - a, _PRIME)) % _PRIME}"

    def before(self, end: int, k: int) -> list[str]:
        """The last k words before a place, the last one as far as it goes."""
        i = bisect_left(self.starts, end)
        return [self.shown(self.at[j][0], min(self.at[j][1], end), j) for j in range(max(0, i - k), i)]

    def after(self, start: int, k: int) -> list[str]:
        """The first k words from a place on, the first one from there."""
        i = bisect_left(self.starts, start)
        if i and self.at[i - 1][1] > start:
            i -= 1
        return [self.shown(max(self.at[j][0], start), self.at[j][1], j) for j in range(i, min(i + k, len(self.at)))]

    def patterns(self, a: int, b: int) -> list[str]:
        """The lexical patterns around a span: words lower-cased, digits masked; a side without words gives none."""
        left, right = self.before(a, 2), self.after(b, 2)
        out = []
        if left:
            out.append("L " + " ".join(left))
        if right:
            out.append("R " + " ".join(right))
        if left and right:
            out.append(f"B {left[-1]} _ {right[0]}")
        return out


_FIELDS = "base array<struct<start:int,rank:int,end:int>>, tokens array<struct<start:int,end:int,rank:int,instance:long,patterns:array<long>>>"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _start():
    def work(column):
        out: dict[str, list] = {"base": [], "tokens": []}
        for x in texts(column):
            if not _MARKED.search(x) and "[" not in x and "(" not in x and "{" not in x:
                out["base"].append([])
                out["tokens"].append([])
                continue
            base = base_spans(x)
            words = Words(x)
            marks = [(a, b, KINDS.index(k)) for k, a, b in base] + [(a, b, -1) for a, b in candidates(x, base)]
            out["base"].append([{"start": a, "rank": KINDS.index(k), "end": b} for k, a, b in base])
            out["tokens"].append([{"start": a, "end": b, "rank": r, "instance": _hash(x[a:b].lower()), "patterns": [_hash(p) for p in words.patterns(a, b)]} for a, b, r in marks])
        return out

    return work


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, gl_row (a number of the row) and RESULT: base spans, and tokens with their patterns."""
    return annotate(docs, _start, _FIELDS, [text], keep).withColumn("gl_row", F.monotonically_increasing_id())


def score(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The accepted patterns: pattern, rank (the kind's place) and confidence. edges: distinct pattern, instance, rank (of a seed, else -1)."""
    seeds = edges.where("rank >= 0").select("instance", "rank").distinct().withColumn("score", F.lit(1.0))
    links = edges.select("pattern", "instance").distinct()
    sizes = links.groupBy("pattern").agg(F.count("*").alias("size"))
    known, before = seeds, None
    n, p = F.col("size"), F.col("confidence")
    bound = (p + _Z**2 / (2 * n) - _Z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n) + _Z**2 / (4 * n * n))) / (1 + _Z**2 / n)
    for _ in range(rounds):
        support = links.join(known, "instance").groupBy("pattern", "rank").agg(F.sum("score").alias("support"))
        confident = support.join(sizes, "pattern").withColumn("confidence", F.least(F.lit(1.0), F.col("support") / n))
        accepted = spool(confident.where(bound >= LEAST).select("pattern", "rank", "confidence"))
        state = accepted.agg(F.count("*"), F.coalesce(F.sum(F.round(p * 1e6).cast("long")), F.lit(0))).first()
        if state == before:
            return accepted
        before = state
        inferred = links.join(accepted, "pattern").groupBy("instance", "rank").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - p))))).alias("score"))
        known = seeds.unionByName(inferred).groupBy("instance", "rank").agg(F.max("score").alias("score"))
    raise RuntimeError(f"patterns did not settle in {rounds} rounds")


def extract(docs: DataFrame, keep: list[str], text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep``, base and added: arrays of (start, rank, end), rank being the kind's place in KINDS."""
    found = spool(find(docs, keep, text))
    tokens = found.select("gl_row", F.explode(f"{RESULT}.tokens").alias("t")).select("gl_row", "t.*")
    linked = tokens.select("rank", "instance", F.explode("patterns").alias("pattern"))
    edges = spool(linked.groupBy("pattern", "instance").agg(F.max("rank").alias("rank")))
    accepted = score(edges, rounds).groupBy("pattern").agg(F.max(F.struct("confidence", "rank")).alias("best"))
    unseen = tokens.where("rank < 0").select("gl_row", "start", "end", F.explode("patterns").alias("pattern"))
    added = (
        unseen.join(accepted, "pattern")
        .groupBy("gl_row", "start", "end")
        .agg(F.max("best").alias("best"))
        .groupBy("gl_row")
        .agg(F.collect_list(F.struct("start", F.col("best.rank").alias("rank"), "end")).alias("added"))
    )
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return found.join(added, "gl_row", "left").select(*(F.col(f"`{k}`") for k in keep), F.col(f"{RESULT}.base").alias("base"), F.coalesce("added", empty).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kind = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["rank"])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: base spans counted by kind, their digest, and all spans."""
    spans = extract(docs, ["doc_id"], **options)
    count = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    return spans.select(
        "doc_id",
        *(count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
