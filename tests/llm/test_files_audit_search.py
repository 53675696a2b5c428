"""Token files, the filter audit and the ranked search against plain versions of their contracts."""

import json
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from gridloom.llm import filter_audit, lexical, token_files
from pyspark.sql import functions as F
from tokenizers import Tokenizer

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    "it's they'RE 'tis 'x' ''s '9", "a  b　 c  d\u0085 e᠎ f​ g", "x<|endoftext|>y <|endoftext|> 1<|endoftext|>", "tab\t x\n\n y \r\n\r\nz  ", "é1 1é é, ,é ñ's 日本 語1", "\x1c \x1d a\x7f b\x00 c",
    "ABC123def!!4,5..six", "a" * 9000 + " " + "1" * 9000, " " * 5000 + "x", "' s ' s", "<|endoftext| >", "a\n1\n!\n'\n x",
]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_pieces_have_the_tokens_of_their_texts():
    library, rnd = Tokenizer.from_file(PATH), random.Random(3)
    parts = ["a", "Zq", "7", "'", "'s", " ", "  ", "\n", "\t", ".", "!!", "é", " ", "　", "日", "<|endoftext|>", "<|", "\x1f", "x́", "½", "_"]
    texts = [*TRICKY, *("".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(1500))]
    want = [x.ids + [2] for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder = token_files.Encoder(PATH, memo=300)
    for size in (1, 7, 400):  # the memo is emptied meanwhile
        got = []
        for k in range(0, len(texts), size):
            ids, n = encoder.encode([x.encode() for x in texts[k : k + size]])
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want
    assert encoder.width == 2 and len(encoder.known) < 4000


def test_other_tokenizers_encode_whole_texts():
    other = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Two  words, it's", "", "ABC123 def\n", "x<|endoftext|> y"]
    ids, n = token_files.Encoder(other).encode([x.encode() for x in texts])
    want = [x.ids + [2] for x in Tokenizer.from_file(other).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def brute_files(rows):
    library = Tokenizer.from_file(PATH)
    # rows of one id: in any order, so equal ids are compared by what does not depend on it
    out, start = [], 0
    for key, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd, docs, empty):
    want = brute_files(sorted(((i, t) for i, t, *_ in docs[1]), key=lambda r: r[0]))
    assert rows_of(token_files.report(docs[0]), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    got = token_files.report(odd[0]).orderBy("start").collect()
    # in ascending order, nulls last, without a gap; each document's ids are its text's
    keys = [r["doc_id"] for r in got]
    assert keys == sorted((k for k in keys if k is not None)) + [k for k in keys if k is None]
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])][:-1].tolist()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(((k, n, c) for k, _, n, c in brute_files([(r[0], r[1]) for r in odd[1]])), key=repr)
    assert token_files.report(empty).count() == 0


def test_token_file_format(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/run"
    named = docs[0].select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("doc.id"), "text")
    shards = token_files.write(named, folder, key="doc.id").orderBy("shard").collect()
    base, seen = 0, []
    for s in shards:
        assert s["base"] == base and s["width"] == 2
        ids = np.fromfile(tmp_path / "run" / f"{s['file']}.bin", "<u2")
        at = np.fromfile(tmp_path / "run" / f"{s['file']}.idx", "<u8")
        names = pa.ipc.open_file(tmp_path / "run" / f"{s['file']}.doc").read_all().column(0).to_pylist()
        assert at[0] == 0 and at[-1] == len(ids) == s["n_ids"] and len(names) == s["n_docs"] == len(at) - 1
        assert (ids[at[1:].astype(int) - 1] == 2).all()
        base += len(ids)
        seen += names
    assert seen == sorted(seen) and len(seen) == docs[0].count()
    first = token_files.read(spark, folder, "name", "string", "first_id long", lambda ids, edges: [ids[edges[:-1]].astype(np.int64)])
    assert first.count() == len(seen) and first.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == base
    # a store without memory mapping is read by ranges
    from pyarrow import fs

    ranged = token_files.mapped(fs.SubTreeFileSystem(str(tmp_path / "run"), fs.LocalFileSystem()), f"{shards[0]['file']}.idx", 8)
    assert ranged[0 : len(ranged)].tolist() == np.fromfile(tmp_path / "run" / f"{shards[0]['file']}.idx", "<u8").tolist()


def brute_audit(rows, labels):
    marks = {}
    for key, quality, toxic in labels:
        if key is not None:
            good, bad = marks.get(key, (False, False))
            marks[key] = good or quality == 1, bad or toxic == 1
    smallest = {}
    for key, text, *_ in rows:
        if key is not None:
            smallest[text or ""] = min(smallest.get(text or "", key), key)
    judged = []
    for key, text, lang, *_ in rows:
        text = text or ""
        words = WORDS.findall(text)
        copy = key is not None and key > smallest[text]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        judged.append((lang or "", {f for f, x in fails.items() if x}, *marks.get(key, (False, False))))
    out = []
    for part in {j[0] for j in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        gone, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                gone[f] += len(lost)
                failing = sum(f in x[0] for x in own)
                lines.append([part, "".join(order), step, len(left), len(lost), failing - len(lost), sum(x[0] == {f} for x in own), sum(x[1] for x in lost), sum(x[2] for x in lost)])
        out += [(*x, gone[x[1][x[2] - 1]]) for x in lines]
    return sorted(out, key=repr)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("block", [1 << 16, 11])
def test_filter_audit(spark, odd, docs, empty, block):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, 1), (9, 1, None), (None, 1, 1), (7, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    small = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for df, rows, given in ((odd[0], odd[1], labels), (docs[0], docs[1], small)):
        counts = filter_audit.left(filter_audit.index(filter_audit.judged(df, given), block=block))
        assert rows_of(filter_audit.audit(counts), *AUDIT) == brute_audit(rows, [tuple(r) for r in given.select("doc_id", "quality", "toxic").collect()])
    assert filter_audit.report(empty, labels).count() == 0
    assert filter_audit.report(docs[0], labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_index_of_many_parts(spark):
    rows = [(f"p{i % 40:02d}", i % 32, i % 4) for i in range(2000)]
    bits = spark.createDataFrame(rows, "part string, fails int, labels int").repartition(3)
    index = filter_audit.index(bits, block=500).cache()
    assert index.agg(F.sum("n")).first()[0] == 2000 and index.agg(F.max("n")).first()[0] == 500
    # parts take the bytes that they span, not a block each
    assert index.select(F.explode("parts.bits").alias("b")).agg(F.sum(F.length("b"))).first()[0] < 2000 / 8 + 3 * index.select(F.explode("parts")).count()
    for part, n in filter_audit.left(index).collect():
        own = [(f, m) for p, f, m in rows if p == part]
        assert n == [[sum(not f & s for f, _ in own), sum(not f & s and m & 1 for f, m in own), sum(not f & s and m >> 1 for f, m in own)] for s in range(32)]


def brute_search(rows, items, top):
    terms = lambda t: [x.translate(str.maketrans(UP, LOW)) for x in TERMS.findall(t or "")]
    held = [(k, terms(t)) for k, t in rows]
    held = [(k, w) for k, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    counts, df = [], {}
    for _, w in held:
        own = {}
        for x in w:
            own[x] = own.get(x, 0) + 1
        counts.append(own)
        for x in own:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (k, w), own in zip(held, counts, strict=True):
            m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * own[x]) // (1000 * own[x] + 20 * m)) for x in set(terms(text)) if x in own)
            if score > 0:
                scored.append((-score, k is None, k or 0, k))
        out += [(item, rank, k, -s) for rank, (s, _, _, k) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("top", "step", "postings", "limit"), [(50, 4096, 2_000_000, 4 << 20), (3, 4, 300, 2000), (1, 1, 50, 400)])
def test_search(spark, odd, docs, empty, monkeypatch, top, step, postings, limit):
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    given = [tuple(r) for r in items.select("item_id", "text").collect()]
    for df, rows in ((docs[0], docs[1]), (odd[0], odd[1])):
        asked = given[:10] + [(None, "the of x1"), (given[0][0], "ÉTÉ naïve END. two"), (901, None), (902, ""), (903, "... !!"), (904, "nowhere zzzz"), (905, "THE the a of Été"), (905, "THE the a of Été")]
        frame = spark.createDataFrame(asked, "item_id: long, text: string" if isinstance(given[0][0], int) else "item_id: string, text: string") if isinstance(given[0][0], int) else spark.createDataFrame([(None if a is None else str(a), b) for a, b in asked], "item_id: string, text: string")
        asked = [tuple(r) for r in frame.collect()]
        got = lexical.search(df, frame.withColumn("row", F.lit(1)), top=top, limit=limit)
        assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search([(r[0], r[1]) for r in rows], asked, top)
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs[0], items.limit(0)).count() == 0


def test_search_stops_early_and_completes_scores():
    """One block, many postings: the best are proven before all are read, and their scores are whole."""
    rnd = np.random.default_rng(7)
    size, k = 4000, 5
    rows = [(d, t, 1) for d in range(size) for t in rnd.choice(30, 12, replace=False)]
    doc, term = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    value = rnd.integers(1, 50, len(rows))
    value[(doc % 800 == 3) & (term < 15)] += 5000
    doc_order = np.lexsort((term, doc))
    block = lexical.Block(size, doc[doc_order], term[doc_order], value[doc_order])
    terms = np.arange(0, 30, 2)
    whole = np.zeros(size, np.int64)
    mine = np.isin(term, terms)
    np.add.at(whole, doc[mine], value[mine])
    want = np.lexsort((np.arange(size), -whole))[:k]
    read = []
    completed = block.completed
    block.completed = lambda score, *rest: read.append((score.sum(), rest[-1])) or completed(score, *rest)
    at, score = block.best(terms, k)
    assert at.tolist() == want.tolist() and score.tolist() == whole[want].tolist()
    assert read[0][1] > 0 and read[0][0] < whole.sum()
    assert json.dumps(block.best(terms, k, int(whole[want[2]]))[0].tolist()) == json.dumps(want[:3].tolist())
