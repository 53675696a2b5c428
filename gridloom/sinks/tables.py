"""Tables for export: long fields, CSV files, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_fields(wide: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, position, field, value: the fields of a wide row in schema order, as text."""
    entry = [F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields, 1)]
    return wide.select(key, F.explode(F.array(*entry)).alias("x")).select(key, "x.*")


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """key and the whole row as JSON."""
    return df.select(key, F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("json"))


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(df: DataFrame, schema) -> DataFrame:
    """The inverse of json_rows."""
    return df.select(F.from_json("json", schema).alias("x")).select("x.*")


def parsed_object(text: Column) -> Column:
    """The first to the last brace of a text, fenced or not, as a JSON variant; null where it is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; a single file where the table is small enough for a reviewer to open."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
