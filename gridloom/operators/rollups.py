"""Roll-ups over findings: errors, hidden sheets, pairs, reviews and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import first_label, lit_array, ordered

SAMPLE_CELLS, EXPLANATION = 25, 400
#: Name hints of hidden sheets, in order: fixed values.
PURPOSES = (
    ("Input", ("input", "raw", "source", "feed", "extract", "import", "data")),
    ("Calculation", ("calc", "working", "model", "engine", "compute", "workings")),
    ("Mapping", ("map", "lookup", "reference", "xref", "code", "lob")),
    ("Control/validation", ("check", "control", "valid", "tie", "recon", "qa", "signoff", "sign-off", "approv")),
    ("Output", ("output", "report", "summary", "pack", "dashboard", "result", "mi")),
)


def severity(area: Column, error: Column) -> Column:
    """High in a final output or for a broken reference, else Medium."""
    return F.when((area == "final output") | (error == "#REF!"), "High").otherwise("Medium")


def error_groups(errors: DataFrame, keys: list[str], order: list[str], label: str, sample: int = SAMPLE_CELLS) -> DataFrame:
    """Count per keys and the first cells by ``order``.

    The sample comes from a bounded aggregate of the first places, not from a list of the whole group.
    """
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, label))
    first = errors.withColumn("gl_place", place).where(F.col("gl_place") <= sample)
    samples = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("gl_place", F.col(label).alias("ref")))), lambda x: x["ref"]).alias("sample_cells"))
    return errors.groupBy(*keys).agg(F.count("*").alias("count")).join(samples, keys)


def error_details(groups: DataFrame, keys: list[str]) -> DataFrame:
    """One row a sample cell."""
    return groups.select(*keys, F.explode("sample_cells").alias("cell"))


def error_rollup(errors: DataFrame, error: str, area: str, file: str, count: str) -> DataFrame:
    """Files and cells per error type and area, with severity and its rank; High first, then by cells."""
    out = errors.groupBy(F.col(error).alias("error_type"), F.col(area).alias("area_type")).agg(F.count_distinct(file).alias("files"), F.sum(count).alias("cells"))
    high = severity(F.col("area_type"), F.col("error_type"))
    return out.withColumn("severity", high).orderBy(F.when(F.col("severity") == "High", 0).otherwise(1), F.desc("cells"), "error_type", "area_type")


def hidden_purpose(name: Column, roles: Column, populated: Column, formulas: Column) -> Column:
    """Purpose of a hidden sheet: its roles first, then its name, then whether it only stores values."""
    has = lambda r: F.array_contains(roles, r)
    by_name = first_label(F.lower(name), PURPOSES)
    return ordered(
        (has("Output"), "Output"),
        (has("Mapping"), "Mapping"),
        (has("Control Check") | has("Validation"), "Control/validation"),
        (has("Input"), "Input"),
        (has("Calculation"), "Calculation"),
        (by_name.isNotNull(), by_name),
        ((populated > 0) & (formulas == 0), "Supporting"),
        default="Unknown",
    )


def hidden_groups(hidden: DataFrame, keys: list[str]) -> DataFrame:
    """Hidden sheets per purpose: names, count, and who depends on them. hidden: name, readers (array)."""
    return hidden.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.array_sort(F.collect_set("name")).alias("sheets"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("readers")))).alias("depended_on_by"),
    )


def coverage(files: DataFrame, status: str, category: str) -> DataFrame:
    """Files per scan status and reason."""
    return files.groupBy(F.col(status).alias("parse_status"), F.col(category).alias("category")).agg(F.count("*").alias("files"))


def overview(files: DataFrame, status: str, errors: str, hidden: str) -> DataFrame:
    """One row: files, files scanned, errors and hidden sheets."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return files.agg(F.count("*").alias("files"), F.count_if(F.col(status) != "failed").alias("scanned"), total(errors).alias("errors"), total(hidden).alias("hidden"))


def pair_rollup(pairs: DataFrame) -> DataFrame:
    """Pairs and distinct files per relationship. pairs: file_a, file_b, relationship."""
    ends = pairs.select("relationship", F.col("file_a").alias("file")).union(pairs.select("relationship", F.col("file_b").alias("file")))
    files = ends.groupBy("relationship").agg(F.count_distinct("file").alias("files"))
    return pairs.groupBy("relationship").agg(F.count("*").alias("pairs")).join(files, "relationship")


def files_in_pairs(files: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Files that stand on either side of a pair."""
    ends = pairs.select(F.col("file_a").alias(key)).union(pairs.select(F.col("file_b").alias(key))).distinct()
    return files.join(ends, key, "left_semi")


def downstream(groups: DataFrame, keys: list[str], outputs: str, k: int = 8) -> DataFrame:
    """The first k of the distinct outputs that a group's rows name."""
    from pyspark.sql.window import Window

    named = groups.select(*keys, F.explode(outputs).alias("o")).distinct()
    first = named.withColumn("gl_place", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("gl_place") <= k)
    names = first.groupBy(*keys).agg(F.array_sort(F.collect_list("o")).alias("downstream"))
    return groups.select(*keys).distinct().join(names, keys, "left").select(*keys, F.coalesce("downstream", lit_array([])).alias("downstream"))


def rationalisation(items: DataFrame, examples: int = 5) -> DataFrame:
    """Distinct unordered pairs per kind of finding and the first examples. items: kind, file_a, file_b."""
    from pyspark.sql.window import Window

    ends = items.select("kind", F.least("file_a", "file_b").alias("a"), F.greatest("file_a", "file_b").alias("b")).distinct()
    # the filter bounds what of a kind goes to one task
    place = F.row_number().over(Window.partitionBy("kind").orderBy("a", "b"))
    first = ends.withColumn("place", place).where(F.col("place") <= examples)
    text = F.concat_ws(" / ", F.col("a").cast("string"), F.col("b").cast("string"))
    shown = first.groupBy("kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]).alias("examples"))
    return ends.groupBy("kind").agg(F.count("*").alias("items")).join(shown, "kind")


FINDING = ("category", "finding", "severity", "files", "affected")


def finding(df: DataFrame, category: str, text: Column, level: Column, files: Column, affected: Column) -> DataFrame:
    """Rows of the common finding schema."""
    return df.select(F.lit(category).alias("category"), text.alias("finding"), level.alias("severity"), files.cast("long").alias("files"), affected.cast("long").alias("affected"))


def findings(parts: list[DataFrame]) -> DataFrame:
    """All findings in one table."""
    return reduce(DataFrame.unionByName, parts)
