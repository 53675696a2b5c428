"""Token ids in flat binary files, and the files read back by memory mapping.

The format, in one folder:

- ``<shard>-<attempt>.bin``: the ids of a shard's documents one after another, each document ended by ``END``, as
  unsigned integers, little-endian: two bytes where the vocabulary allows it, else four.
- ``<shard>-<attempt>.idx``: 64-bit unsigned offsets, little-endian: where each document begins in the .bin file, in
  ids, and where the last one ends.
- ``<shard>-<attempt>.doc``: the documents' ids in the same order, an Arrow file.
- ``manifest/``: a Parquet table with one row a shard: its number, file name, bytes an id, number of documents and of
  ids, and ``base``, the ids of all shards before it.  A document's place in the whole is base + offset.

Documents are in ascending order of their ids over all shards: they are dealt by ranges, encoded and written where they
arrive, so texts move once and ids never do.  A shard's base is a prefix sum over the shards' totals, one row each.
Every attempt of a task writes files of its own and the manifest names those of the attempt that Spark committed, so a
lost executor or a second attempt leaves at most files that no one reads.

A text is cut into pieces where its tokens part in any case.  Equal pieces of a stretch of text are told by one hash pass
in Arrow, those that a task has not met go through the library in batches, and the ids of all pieces are gathered at once.
A tokenizer that is not byte-level encodes whole texts.

Defined results: a null or empty text is its end id alone; a null doc_id comes after all others; documents of one id are
ordered by their texts' hashes, and equal rows are written one by one; a very long text is encoded whole, some hundred
thousand pieces at a time; an empty table gives a manifest without rows; further columns, whatever their names, are not
read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from gridloom.llm.common import chunks, name, offsets, raw_texts, shared_folder
from gridloom.llm.tokens import TOKENIZER, batches, stretches

END = 2
#: Pieces that are looked up and gathered at once, and ids that are read back at once.
PIECES, IDS = 400_000, 2_000_000
#: Pieces, and their ids, that a worker remembers; beyond it keeps those of the text at hand.
MEMO, MEMO_IDS = 600_000, 8_000_000
MANIFEST = "shard long, file string, width int, n_docs long, n_ids long"


#: Classes of ASCII characters; two neighbours of different classes are cut, but for what ``piece_starts`` says.
_OPEN, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE = range(6)
_CLASSES = np.array([
    _OPEN if c >= 0x80 or c < 0x09 or 0x0E <= c < 0x20 or c == 0x7F
    else _SPACE if c <= 0x20 else _DIGIT if chr(c).isdigit() else _LETTER if chr(c).isalpha() else _QUOTE if c == 0x27 else _MARK
    for c in range(256)
], np.uint8)
#: By the classes of the character before and of its own: whether a place is one between two tokens whatever stands around it.
_CUTS = np.zeros((6, 6), bool)
_CUTS[_LETTER, [_DIGIT, _MARK, _QUOTE]] = _CUTS[_DIGIT, [_LETTER, _MARK, _QUOTE]] = _CUTS[_MARK, [_LETTER, _DIGIT]] = True
_CUTS[_QUOTE, _DIGIT] = True
_CUTS[[_LETTER, _DIGIT, _MARK, _QUOTE], _SPACE] = True
_CUTS = _CUTS.ravel()


def piece_starts(data: np.ndarray, special: list[bytes] = ()) -> np.ndarray:
    """A mask of the places where a UTF-8 text may be cut before a byte, so that the parts' tokens are the text's.

    Byte-level pre-tokenisation parts letters, digits, marks and white space.  What follows an apostrophe may belong to it,
    a space belongs to what follows it, and the last of several white spaces is parted from the others; so no cut is made
    after an apostrophe before a letter, nor after white space.  Characters beyond ASCII are left with what stands around
    them, but for a space after one that is no white space.  Nor is a special string cut.
    """
    if not len(data):
        return np.zeros(0, bool)
    kind = _CLASSES[data]
    mask = np.empty(len(data), bool)
    mask[0] = True
    np.take(_CUTS, kind[:-1] * np.uint8(6) + kind[1:], out=mask[1:])
    at = np.flatnonzero((data[1:] == 0x20) & (data[:-1] >= 0x80)) + 1
    last, second, third = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    e1 = (third == 0xE1) & (((second == 0x9A) & (last == 0x80)) | ((second == 0xA0) & (last == 0x8E)))
    e2 = (third == 0xE2) & (((second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))) | ((second == 0x81) & (last == 0x9F)))
    e3 = (third == 0xE3) & (second == 0x80) & (last == 0x80)
    mask[at[~(two | e1 | e2 | e3)]] = True
    raw = data.tobytes() if len(special) else b""
    for text in special:
        k = raw.find(text)
        while k >= 0:
            mask[k + 1 : k + len(text)] = False
            k = raw.find(text, k + 1)
    return mask


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ids that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts by one tokenizer file, with a bounded memo of pieces."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Bytes of an id.
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # where texts may be cut is known of byte-level tokenisers; other texts are encoded whole
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def keep(self, pieces: list[bytes]) -> None:
        """Forget all pieces but these."""
        stay = [x for x in pieces if x in self.known]
        place = np.fromiter(map(self.known.__getitem__, stay), np.int64, len(stay))
        ids = gathered(self.ids, self.starts[place], self.sizes[place])
        self.known = dict(zip(stay, range(len(stay)), strict=True))
        self.ids, self.sizes = ids, self.sizes[place]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def learn(self, fresh: list[bytes]) -> None:
        """Encode pieces by the library in batches of about equal bytes and keep their ids."""
        cut = [stretches(x.decode()) if self.cuts else [x.decode()] for x in fresh]
        parts = [x for piece in cut for x in piece]
        found: list[list[int]] = [[]] * len(parts)
        for batch in batches([len(x) if x.isascii() else len(x.encode()) for x in parts]):
            for k, e in zip(batch, self.tokenizer.encode_batch_fast([parts[k] for k in batch], add_special_tokens=False), strict=True):
                found[k] = e.ids
        owner = np.repeat(np.arange(len(fresh)), np.fromiter(map(len, cut), np.int64, len(fresh)))
        each = np.fromiter(map(len, found), np.int64, len(found))
        sizes = np.bincount(owner, weights=each, minlength=len(fresh)).astype(np.int64)
        ends = len(self.ids) + np.cumsum(sizes)
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(each.sum()))]
        self.starts, self.sizes = np.r_[self.starts, ends - sizes], np.r_[self.sizes, sizes]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))

    def encode(self, texts: list[bytes], end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id; and each text's number of ids, that one included."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(lengths) - lengths
        mask = piece_starts(data, self.special) if self.cuts else np.zeros(len(data), bool)
        mask[begin[lengths > 0]] = True
        starts = np.flatnonzero(mask)
        bounds = np.r_[starts, len(data)]
        counts, out = np.zeros(len(starts), np.int64), []
        for k in range(0, len(starts), PIECES):
            edge = bounds[k : k + PIECES + 1]
            cut = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge - edge[0]), pa.py_buffer(data[edge[0] : edge[-1]])])
            coded = cut.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.known) > self.memo or len(self.ids) > MEMO_IDS:
                self.keep(distinct)
            self.learn([x for x in distinct if x not in self.known])
            place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
            counts[k : k + len(place)] = self.sizes[place]
            out.append(gathered(self.ids, self.starts[place], self.sizes[place]).astype(f"<u{self.width}"))
        # ids of a text: those of the pieces that begin in it
        so_far = np.r_[0, np.cumsum(counts)]
        size = so_far[np.searchsorted(starts, begin + lengths)] - so_far[np.searchsorted(starts, begin)] + 1
        ids = np.full(int(size.sum()), end, f"<u{self.width}")
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(size) - 1] = False
        ids[inside] = np.concatenate(out) if out else np.zeros(0, np.uint8)
        return ids, size


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, and its memo, which outlive its tasks."""
    return Encoder(path)


def place_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path in it."""
    return pafs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (pafs.LocalFileSystem(), folder)


def write(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Write all documents' ids to a new folder that all executors share, and return the manifest.

    tokenizer: a file that every executor has.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    picked = docs.select(name(key).alias("k"), name(text).alias("t"))
    # the last two keep repeated ids, and repeated rows, from being one task's
    order = [F.col("k").asc_nulls_last(), F.col("h"), F.col("r")]
    keyed = picked.select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("r"))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")
    kind = to_arrow_type(picked.schema["k"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        worker = encoder(tokenizer)
        store, path = place_of(folder)
        store.create_dir(path, recursive=True)
        shard = TaskContext.get().partitionId()
        file = f"{shard:06d}-{uuid.uuid4().hex}"
        sizes: list[np.ndarray] = []
        schema = pa.schema([("doc", kind)])
        with store.open_output_stream(f"{path}/{file}.bin") as ids_out, store.open_output_stream(f"{path}/{file}.doc") as doc_out, pa.ipc.new_file(doc_out, schema) as docs_out:
            for batch in _and(head, batches):
                for part in chunks(batch, 1):
                    ids, size = worker.encode(raw_texts(part.column(1)), end)
                    ids_out.write(ids.data)
                    sizes.append(size)
                    docs_out.write_batch(pa.record_batch([part.column(0).cast(kind)], schema=schema))
        at = offsets(np.concatenate(sizes)).astype("<u8")
        with store.open_output_stream(f"{path}/{file}.idx") as out:
            out.write(at.data)
        row = [[shard], [file], [worker.width], [len(at) - 1], [int(at[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["shard", "file", "width", "n_docs", "n_ids"])

    spark = docs.sparkSession
    # the shards' totals, and from them their bases
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/shards")
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def _and(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a shard: shard, file, width, n_docs, n_ids and base."""
    return spark.read.schema(f"{MANIFEST}, base long").parquet(f"{folder}/manifest")


class Ranged:
    """Unsigned integers of a file in a store without memory mapping, read by ranges."""

    def __init__(self, store: pafs.FileSystem, path: str, width: int):
        self.file, self.width = store.open_input_file(path), width

    def __len__(self) -> int:
        return self.file.size() // self.width

    def __getitem__(self, at: slice) -> np.ndarray:
        self.file.seek(at.start * self.width)
        return np.frombuffer(self.file.read((at.stop - at.start) * self.width), f"<u{self.width}")


def mapped(store: pafs.FileSystem, path: str, width: int) -> np.ndarray | Ranged:
    """The unsigned integers of a file: mapped where the file is local or mounted, else read by ranges."""
    if not isinstance(store, pafs.LocalFileSystem):
        return Ranged(store, path, width)
    return np.memmap(path, f"<u{width}", "r") if os.path.getsize(path) else np.zeros(0, f"<u{width}")


class Shard:
    """One shard's files."""

    def __init__(self, store: pafs.FileSystem, path: str, file: str, width: int):
        self.ids, self.offsets = mapped(store, f"{path}/{file}.bin", width), mapped(store, f"{path}/{file}.idx", 8)
        self.source = store.open_input_file(f"{path}/{file}.doc")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def documents(self) -> Iterator[tuple[int, pa.Array]]:
        """The documents' ids in parts, each with its first one's number."""
        at = 0
        with pa.ipc.open_file(self.source) as reader:
            for k in range(reader.num_record_batches):
                batch = reader.get_batch(k)
                yield at, batch.column(0)
                at += batch.num_rows


def read(spark: SparkSession, folder: str, key: str, kind: str, fields: str, of: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """One row a document from the files: key, start, n_tokens and ``fields``, which ``of`` gives, as lists or arrays, from
    some documents' ids and where each of them begins and the last one ends in those.

    A task reads a shard: it maps the files and looks at no more than ``IDS`` ids at once, a longer document alone.
    """
    shards = manifest(spark, folder)
    schema = f"{key} {kind}, start long, n_tokens long, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place_of(folder)
        for batch in batches:
            for file, width, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(store, path, file, width)
                for at, docs in shard.documents():
                    yield from rows(shard, base, at, docs)

    def rows(shard: Shard, base: int, at: int, docs: pa.Array) -> Iterator[pa.RecordBatch]:
        edges = np.array(shard.offsets[at : at + len(docs) + 1]).astype(np.int64)
        i = 0
        while i < len(docs):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + IDS, "right")) - 1)
            own = edges[i : j + 1]
            made = of(shard.ids[int(own[0]) : int(own[-1])], own - own[0])
            columns = [docs.slice(i, j - i), pa.array(base + own[:-1]), pa.array(np.diff(own)), *(pa.array(x) for x in made)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])
            i = j

    # as many tasks as shards, however small the manifest is
    return shards.select("file", "width", "base").repartition(max(1, shards.count())).mapInArrow(run, schema)


def checksums(ids: np.ndarray, edges: np.ndarray) -> list:
    """Unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    whole = np.ascontiguousarray(ids, "<u4").view(np.uint8)
    at = (4 * edges).tolist()
    return [np.array([zlib.crc32(whole[a:b]) for a, b in zip(at, at[1:], strict=False)], np.int64)]


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document, read back from the files: where its ids start, their number, and their checksum."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/gridloom-spool/tokens-{uuid.uuid4().hex}"
    write(docs, folder, **options)
    return read(spark, folder, "doc_id", docs.schema["doc_id"].dataType.simpleString(), "ids_crc32 long", checksums)
