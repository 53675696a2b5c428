"""What a reviewer's screen asks for, as functions over the assessment's tables; no server is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import rollups, similarity

Tables = dict[str, DataFrame]


def overview(t: Tables) -> DataFrame:
    """Files, files scanned, errors and hidden sheets."""
    return rollups.overview(t["file_fact"], "parse_status", "cached_errors", "hidden_count")


def files(t: Tables, query: str = "", status: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of files whose name or path holds the query, letters in either case."""
    out = t["file_fact"]
    if query:
        text = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        out = out.where(F.col("file_name").ilike(text) | F.col("path").ilike(text))
    if status:
        out = out.where(F.col("parse_status") == status)
    return out.orderBy("file_name", "file_pk").offset(offset).limit(limit)


def file(t: Tables, file_pk: str) -> Tables:
    """Everything about one file: its facts, sheets, regions, errors, hidden groups and pairs."""
    own = {k: t[k].where(F.col("file_pk") == file_pk) for k in ("file_fact", "sheet_fact", "region", "error_group", "hidden_group", "narrative")}
    return own | {"pair": t["pair"].where((F.col("a") == file_pk) | (F.col("b") == file_pk))}


def compare(t: Tables, ids: list[str], limit: int = 30) -> DataFrame:
    """Pairs among up to twenty chosen files, the best first."""
    if len(set(ids)) > 20:
        raise ValueError("at most 20 files can be compared side by side")
    chosen = t["token"].where(F.col("file").isin(ids))
    return similarity.compared(similarity.similar_pairs(chosen), ids, limit)


def views(t: Tables, prefix: str = "") -> None:
    """All tables as temporary views, for SQL."""
    for name, df in t.items():
        df.createOrReplaceTempView(prefix + name)
