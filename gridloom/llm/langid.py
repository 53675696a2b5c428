"""Language identification by word-first backoff.

A word of the model scores by its log frequency in each language.  A word that the
model lacks is scored by its character n-grams, from ``LONGEST`` letters down: the longest
length at which the model knows any of them decides; a word that no length knows
says nothing.  A text's language is the one with the highest sum over its words.
Log frequencies are whole numbers, so sums do not depend on the order of words.

The classifier is fitted on a sample of labelled rows, about ``SAMPLE`` documents a
language, chosen by a hash of the id; it has all words and n-grams of the sample.  What is
broadcast is counted first: where the sample has more than ``ENTRIES`` words and n-grams,
it is halved until it has not.  Prediction covers all rows in one Arrow pass without a
shuffle.  Fitting is an action that runs while the result is built.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text where nothing could be learned; ties go to the first language by name; very long
texts are read whole; equal texts and repeated rows are predicted alike; an empty table
gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import RESULT, annotate, name, spool, texts

SAMPLE, ENTRIES, LONGEST = 1500, 20_000_000, 5
PLACES = 1_000_000_000
#: Log frequencies are multiples of one in so many.
SCALE = 1 << 20
UND = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Unseen words that a task remembers, and words of a text that are summed at once.
_MEMO, _STRETCH = 300_000, 1 << 16


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Is crc32 of the id, as text, this remainder?  A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == fold, F.lit(False))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, entries: int = ENTRIES) -> dict:
    """The model: languages, and log frequencies of words and n-grams for each."""
    rows = labelled.where(name(lang).isNotNull() & name(text).isNotNull()).select(name(lang).cast("string").alias("gl_lang"), name(text).alias("gl_text"), name(key).alias("gl_key"))
    sizes = {r["gl_lang"]: r["count"] for r in rows.groupBy("gl_lang").count().collect()}
    while True:
        words = spool(_words(rows, sizes, sample))
        grams = spool(_grams(words))
        if words.count() + grams.count() <= entries:
            break
        sample //= 2
    langs = sorted(sizes)
    of_words, of_grams = words.toArrow(), grams.toArrow()
    lengths = pc.utf8_length(of_grams["item"])
    by_length = {k: _frequencies(of_grams.filter(pc.equal(lengths, k)), langs) for k in range(LONGEST, 0, -1)}
    return {"langs": langs, "words": _frequencies(of_words, langs), "grams": by_length}


def _words(rows: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """gl_lang, item, n: the words of about ``sample`` documents a language."""
    shares = rows.sparkSession.createDataFrame([(k, sample * PLACES // n) for k, n in sizes.items()], "gl_lang string, gl_share long")
    # a fixed hash places every document; a language takes those below its share of the places
    place = F.pmod(F.xxhash64(F.lit("langid"), "gl_key", F.length("gl_text")), F.lit(PLACES))
    # one row a language goes to every task: texts are picked where they are
    taken = rows.withColumn("gl_place", place).join(F.broadcast(shares), "gl_lang").where(F.col("gl_place") < F.col("gl_share"))
    found = F.regexp_extract_all(F.lower("gl_text"), F.lit(r"(\p{L}+)"), 1)
    return taken.select("gl_lang", F.explode(found).alias("item")).groupBy("gl_lang", "item").agg(F.count("*").alias("n"))


def _grams(words: DataFrame) -> DataFrame:
    """gl_lang, item, n: the letters of the words, and their n-grams with a space at either end."""
    padded = F.concat(F.lit(" "), "item", F.lit(" "))

    def of_length(k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, F.lit(k)))
        return F.when(F.length(padded) >= k, grams).otherwise(F.array().cast("array<string>"))

    every = F.concat(F.split("item", ""), *(of_length(k) for k in range(2, LONGEST + 1)))
    return words.select("gl_lang", "n", F.explode(every).alias("item")).where("item <> ''").groupBy("gl_lang", "item").agg(F.sum("n").alias("n"))


def _frequencies(counts: pa.Table, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Items by number, and a matrix of smoothed log frequencies: items x languages."""
    items = counts["item"].to_pylist()
    number = {x: i for i, x in enumerate(sorted(set(items)))}
    place = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(number), len(langs)))
    table[[number[x] for x in items], [place[x] for x in counts["gl_lang"].to_pylist()]] = counts["n"].to_numpy()
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * (len(number) + 1)))
    return number, np.rint(logs * SCALE).astype(np.int32)


class Predictor:
    """Scores texts by a model; a memo keeps the scores of words that the model lacks."""

    def __init__(self, model: dict):
        self.langs, self.grams = model["langs"], model["grams"]
        number, table = model["words"]
        self.table = np.vstack([table, np.zeros((1, len(self.langs)), np.int32)])
        self.number, self.silent = number, len(number)
        self.memo: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's known n-grams of the longest length that has any."""
        padded = f" {word} "
        for k, (number, table) in self.grams.items():
            source = padded if k > 1 else word
            rows = [i for j in range(len(source) - k + 1) if (i := number.get(source[j : j + k])) is not None]
            if rows:
                return np.rint(table[rows].mean(axis=0)).astype(np.int64)
        return np.zeros(len(self.langs), np.int64)

    def unseen(self, word: str) -> np.ndarray:
        out = self.memo.get(word)
        if out is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            out = self.backoff(word)
            self.memo[word] = out
        return out

    def predict(self, text: str) -> tuple[str, float]:
        words = _WORD.findall(text.lower())
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UND, 0.0
        total = np.zeros(len(self.langs), np.int64)
        for a in range(0, len(words), _STRETCH):
            part = words[a : a + _STRETCH]
            ids = np.fromiter(map(self.number.get, part, repeat(self.silent)), np.int64, len(part))
            total += self.table[ids].sum(axis=0, dtype=np.int64)
            for i in np.flatnonzero(ids == self.silent).tolist():
                total += self.unseen(part[i])
        best = int(np.argmax(total))
        # the texts' words are no independent draws: a share of the log odds, by the root of their number
        odds = np.exp((total - total[best]) / (SCALE * max(1.0, len(words) ** 0.5)))
        return self.langs[best], float(1 / odds.sum())


def predict(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and RESULT: lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        predictor = Predictor(sent.value)

        def work(column):
            found = [predictor.predict(x) for x in texts(column)]
            return {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return work

    return annotate(docs, start, "lang_pred string, score double", [text], keep)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: whether it was held out of the training, its predicted language, and the score."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), **options)
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(f"{RESULT}.lang_pred"), F.col(f"{RESULT}.score"))
