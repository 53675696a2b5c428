"""Assessment fields: what is said of a file or a sheet, on what basis, how surely, and why.

A field is a struct of value, basis, confidence and evidence.  The bases are ``extracted`` (read from the file),
``derived`` (by rules; the confidence is a heuristic), ``drafted`` (by an assessor), ``compared`` (with the other
files) and ``ask`` (only a person knows; the evidence holds the question).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import lit_array

FIELD = "struct<value:string,basis:string,confidence:double,evidence:array<string>>"


def field(value: Column, basis: str, confidence: Column | float | None = None, evidence: Column | tuple[str, ...] = ()) -> Column:
    """A field; an empty value is none."""
    why = evidence if isinstance(evidence, Column) else lit_array(list(evidence))
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.nullif(value.cast("string"), F.lit("")).alias("value"), F.lit(basis).alias("basis"), F.round(sure.cast("double"), 2).alias("confidence"), F.coalesce(why, lit_array([])).alias("evidence")).cast(FIELD)


def extracted(value: Column, *evidence: str) -> Column:
    return field(value, "extracted", 1.0, evidence)


def derived(value: Column, confidence: Column | float, evidence: Column | tuple[str, ...] = ()) -> Column:
    return field(value, "derived", confidence, evidence)


def drafted(value: Column, basis: Column) -> Column:
    return field(value, "drafted", None, F.array(basis))


def compared(value: Column, evidence: Column) -> Column:
    return field(value, "compared", None, evidence)


def ask(question: str) -> Column:
    """A field that no file can tell."""
    return field(F.lit(None).cast("string"), "ask", None, (question,))


def listed(items: Column) -> Column:
    """The items of a list as one text, null for none."""
    return F.nullif(F.array_join(items, "; "), F.lit(""))


def long_table(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, place, field, value, basis, confidence, evidence: one row a field, in the order of ``names``."""
    entry = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("field"), F.col(n).alias("x")) for i, n in enumerate(names, 1)]
    return wide.select(*keys, F.explode(F.array(*entry)).alias("f")).select(*keys, "f.place", "f.field", "f.x.*")


def wide_table(long: DataFrame, keys: list[str], names: list[str], otherwise: Column | None = None) -> DataFrame:
    """keys and one column a field, its value; where a field has none, its basis and evidence say why."""
    said = F.coalesce("value", otherwise if otherwise is not None else F.when(F.col("basis") == "ask", F.concat(F.lit("to ask: "), F.array_join("evidence", "; "))).otherwise("none"))
    return long.select(*keys, "field", said.alias("said")).groupBy(*keys).pivot("field", names).agg(F.first("said"))
