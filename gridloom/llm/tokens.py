"""Token counts: batch encoding inside Arrow functions, lengths only.

A text is cut where a space follows a character that is no white space.  No token of
a byte-level BPE spans such a place, since the space opens the next piece of its
pre-tokenisation and no special string holds a space; so the pieces' counts add up to
the text's.  A piece of more than ``LONG`` characters is cut again where other white space
follows, and between ASCII letters and digits, which pre-tokenisation always parts and
no special string joins.  Pieces that a task has met are counted from a bounded memo; the
others of a chunk are encoded by the library in batches of about equal UTF-8 bytes, long
ones together with few others.  Chunks are cut by bytes too, so a very long text neither
waits for nor holds up many short ones.

Defined results: a null or empty text has no bytes and no tokens; a very long text is
counted whole, and so is a stretch without a safe place; equal texts and repeated rows are
counted one by one; an empty table gives no rows; further columns, whatever their names,
are not read.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import RESULT, annotate, texts

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
BATCH_BYTES = 64 << 10
MEMO = 400_000
LONG = 4096
_UNSAFE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def pieces(text: str) -> tuple[str, list[str]]:
    """The first piece, and the others without the space that each begins with."""
    if not _UNSAFE.search(text) and text[:1] != " ":
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _CUT.split(text)
    return first, [x[1:] for x in rest]


def stretches(text: str, limit: int = LONG) -> list[str]:
    """A text of more than ``limit`` characters in parts of half that and more, cut at safe places only."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    for m in _SAFE.finditer(text):
        if m.start() - start >= limit // 2:
            out.append(text[start : m.start()])
            start = m.start()
    return [*out, text[start:]]


def batches(sizes: list[int], limit: int = BATCH_BYTES) -> list[list[int]]:
    """Numbers of items in lists of at most ``limit`` bytes each, larger items alone."""
    out: list[list[int]] = []
    size = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        if not out or size + sizes[i] > limit:
            out.append([])
            size = 0
        out[-1].append(i)
        size += sizes[i]
    return out


class Counter:
    """Token counts by one tokenizer file, with a memo of pieces."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def encode(self, items: list[str]) -> list[int]:
        """Tokens of each item, by one call of the library."""
        return [len(x) for x in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def encoded(self, items: list[str]) -> list[int]:
        """Tokens of each item, by batches of about equal bytes."""
        parts = [(i, x) for i, item in enumerate(items) for x in stretches(item)]
        out = [0] * len(items)
        for batch in batches([len(x) if x.isascii() else len(x.encode()) for _, x in parts]):
            for k, n in zip(batch, self.encode([parts[k][1] for k in batch]), strict=True):
                out[parts[k][0]] += n
        return out

    def counts(self, items: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = [pieces(x) for x in items]
        if len(self.known) > self.memo:
            self.known.clear()
        wanted = set().union(*(rest for _, rest in cut))
        fresh = list(wanted - self.known.keys())
        self.known.update(zip(fresh, self.encoded([" " + x for x in fresh]), strict=True))
        firsts = list({f for f, _ in cut})
        heads = dict(zip(firsts, self.encoded(firsts), strict=True))
        get = self.known.__getitem__
        out = [heads[f] + sum(map(get, rest)) for f, rest in cut]
        for x in wanted:
            if len(x) > 64:  # long pieces seldom come again
                self.known.pop(x, None)
        return out


def count(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The columns ``keep`` and RESULT: n_bytes and n_tokens. tokenizer: a file that every executor has."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)

    def start():
        counter = Counter(tokenizer)

        def work(column):
            items = texts(column)
            return {"n_bytes": [len(x.encode()) for x in items], "n_tokens": counter.counts(items)}

        return work

    return annotate(docs, start, "n_bytes long, n_tokens long", [text], keep)


def report(docs: DataFrame, limit: int = LIMIT, **options) -> DataFrame:
    """One row a document: bytes, tokens, and whether there are more than ``limit``."""
    found = count(docs, ["doc_id"], **options)
    n = F.col(f"{RESULT}.n_tokens")
    return found.select("doc_id", F.col(f"{RESULT}.n_bytes"), n, (n > limit).alias("over_limit"))
