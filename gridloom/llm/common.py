"""What the operators of this subpackage share: reading, spooling, Arrow passes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.storage import clear_spool, discard, mark, release, scope, shared_folder, spool

__all__ = ["annotate", "chunks", "clear_spool", "discard", "free_name", "let", "mark", "name", "offsets", "raw_texts", "release", "scope", "shared_folder", "sheltered", "spool", "table", "texts"]

#: The struct column in which an Arrow pass returns what it found for a row.
RESULT = "gl_result"
#: Bytes of text that an Arrow pass works on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 4 << 20

_SPACE = [c if chr(c) not in " \t\n\v\f\r" else 0x20 for c in range(256)]
#: A-Z lower-cased, every byte that ends a `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` word made a space.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
#: A-Z lower-cased, white space made a space; bytes.split() then gives `[^\x20\x09-\x0D]+`.
SPACE_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else _SPACE[c] for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(wanted: str, taken: list[str]) -> str:
    """The wanted column name, or it with the first number that no column has; Spark's names ignore case."""
    held, out, k = {x.lower() for x in taken}, wanted, 0
    while out.lower() in held:
        k += 1
        out = f"{wanted}_{k}"
    return out


def sheltered(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that returns its first table's columns: those whose names begin like this subpackage's own,
    with ``gl_``, bear other names meanwhile, so that neither can overwrite the other."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        own = docs.columns
        if not any(c.lower().startswith("gl_") for c in own):
            return operator(docs, *args, **options)
        new: list[str] = []
        for i, c in enumerate(own):
            new.append(free_name(f"held_{i}_{c}", [*own, *new]) if c.lower().startswith("gl_") else c)
        back = dict(zip(new, own, strict=True))
        renamed = docs.select(*(name(c).alias(n) for c, n in zip(own, new, strict=True)))
        moved = {k: back_to for back_to, k in back.items()}
        options = {k: moved.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        out = operator(renamed, *args, **options)
        return out.select(*(name(c).alias(back.get(c, c)) for c in out.columns))

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body, lambdas included, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(batch: pa.RecordBatch, sized: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in column ``sized``, a longer value alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def annotate(
    df: DataFrame,
    start: Callable[[], Callable[..., dict]],
    fields: str,
    inputs: list[str],
    keep: list[str],
) -> DataFrame:
    """One Arrow pass without a shuffle: the columns ``keep``, and RESULT, a struct of ``fields`` for every row.

    ``start()`` runs once a task and gives a function from the Arrow arrays of ``inputs`` (the first is the
    text, by whose bytes batches are cut) to one list or array for each field.
    """
    names = list(dict.fromkeys([*keep, *inputs]))
    picked = df.select(*map(name, names))
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([*(picked.schema[k] for k in keep), T.StructField(RESULT, made)])
    arrow = to_arrow_schema(schema)
    struct = arrow.field(RESULT).type
    kept, given = len(keep), [names.index(x) for x in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in chunks(batch, given[0]):
                found = work(*(part.column(i) for i in given))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(struct, (found[f.name] for f in struct), strict=True)]
                out = pa.StructArray.from_arrays([a.cast(f.type) for a, f in zip(arrays, struct, strict=True)], fields=list(struct))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], out], names=[*(f.name for f in arrow)])

    # an Arrow pass takes no names with dots, and needs none
    return picked.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """The texts as Python strings; a null one is empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null one is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def offsets(lengths: list[int]) -> np.ndarray:
    """Start of each part, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
