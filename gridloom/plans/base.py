"""Reading tables for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame, rows: int = 1 << 19) -> int:
    """Tasks for a table of which each is to have some ``rows`` rows, however large it is; at least one a core. Counted from the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def case(value: str, pairs: list[tuple[str, tuple[str, ...]]] | tuple, default: str) -> str:
    """SQL: the label of the first entry one of whose words the text holds."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    tests = [f"WHEN {' OR '.join(f'contains({value}, {quoted(w)})' for w in words)} THEN {quoted(label)}" for label, words in pairs]
    return f"CASE {' '.join(tests)} ELSE {default} END"


def any_of(value: str, words) -> str:
    """SQL: does the text hold any of the words?"""
    return "(" + " OR ".join("contains({}, '{}')".format(value, w.replace("'", "''")) for w in words) + ")"
