"""What an assessor is given of a file, and what of its answers holds.

A bundle is one row a file with all evidence nested in it, free of cell values: facts of the file, and its sheets in order
with their facts and headers.  An assessor, a model or a person, answers with a JSON text.  Answers are parsed by a
typed schema and taken field by field: what is missing, empty, of another type or about a sheet that is not there is
replaced by what can be said without an assessor, and every text bears its basis.  Claims about reconciliations hold only
as far as the file's own names and headers support them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalars import contains_any

#: Headers of a sheet that a bundle holds.
HEADERS = 100
# Words that speak of a comparison: fixed values.
COMPARED = ("recon", "variance", "difference", "tie out", "tie-out", "matched", "match status", "agreed", "comparison")

FILE_TEXTS = ("purpose", "outcome", "process", "sub_process")
ANSWER = f"{', '.join(f'{c} string' for c in FILE_TEXTS)}, outputs array<string>, tabs map<string, string>"
CLAIMS = "reconciliations array<struct<worksheet: string, source_a: string, source_b: string, matching_criteria: string, tolerance: string, exception_logic: string, evidence: array<struct<worksheet: string, text: string>>>>"


def _distinct(texts: Column) -> Column:
    return F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (F.trim(x) != "")))


def bundles(files: DataFrame, tabs: DataFrame, headers: int = HEADERS) -> DataFrame:
    """file and bundle.

    files: file and any columns, which become the bundle's own.  tabs: file, place, name, headers (an array) and any columns,
    which become those of the bundle's sheets, in order of place; of headers the first ``headers`` different ones.
    """
    facts = [c for c in tabs.columns if c not in ("file", "place", "headers")]
    # names and headers of all sheets, each once, are what a process may be read from
    one = F.struct("place", *facts, F.slice(_distinct(F.col("headers")), 1, headers).alias("headers"), _distinct(F.concat(F.array("name"), "headers")).alias("said"))
    nested = tabs.groupBy("file").agg(F.sort_array(F.collect_list(one)).alias("all"))
    shown = F.transform("all", lambda t: F.struct(*(t[c].alias(c) for c in [*facts, "headers"])))
    nested = nested.select("file", F.size("all").alias("sheet_count"), F.array_distinct(F.flatten(F.transform("all", lambda t: t["said"]))).alias("business_evidence"), shown.alias("tabs"))
    own = [c for c in files.columns if c != "file"]
    none = nested.schema
    filled = [F.coalesce("sheet_count", F.lit(0)).alias("sheet_count"), *(F.coalesce(c, F.array().cast(none[c].dataType)).alias(c) for c in ("business_evidence", "tabs"))]
    return files.join(nested, "file", "left").select("file", F.struct(*own, *filled).alias("bundle"))


def offline_tab(tab: Column) -> Column:
    """What can be said of a sheet without an assessor: its kind, and the first of its headers."""
    heads = F.array_join(F.slice(tab["headers"], 1, 4), ", ")
    return F.concat(tab["category"], F.lit(" sheet, "), tab["information"], F.when(heads != "", F.concat(F.lit(": "), heads)).otherwise(""), F.when(tab["hidden"], " (hidden)").otherwise(""))


#: What is said of a file where no assessor has answered.
UNKNOWN = {"purpose": "not established: ask the owner what the file is for", "outcome": "not established: ask who uses its result", "process": "not established: ask the owner", "sub_process": "not established: ask the owner"}


def narrated(bundle: DataFrame, answers: DataFrame, basis: str = "inferred") -> DataFrame:
    """file, field, sheet (null for the file's own), text and basis from the assessor's answers (file, answer: JSON text, one a file).

    A text of the answer has the given basis; where it has none that can be taken, the offline one has ``drafted`` if the file
    was not answered for, else ``drafted: offline fallback``.  The bundle's sheets need category, information and hidden.
    """
    parsed = answers.select("file", F.from_json("answer", ANSWER).alias("a"), F.lit(True).alias("asked"))
    both = bundle.join(parsed, "file", "left")
    fallen = F.when(F.col("asked"), "drafted: offline fallback").otherwise("drafted")

    def taken(text: Column, offline: Column, field: str, sheet: Column) -> Column:
        text = F.trim(text)
        # an object or a list where a text should be comes as its JSON
        ok = F.coalesce((text != "") & ~F.substring(text, 1, 1).isin("{", "["), F.lit(False))
        return F.struct(F.lit(field).alias("field"), sheet.cast("string").alias("sheet"), F.when(ok, text).otherwise(offline).alias("text"), F.when(ok, basis).otherwise(fallen).alias("basis"))

    own = F.array(*(taken(F.col(f"a.{c}"), F.lit(UNKNOWN[c]), c, F.lit(None)) for c in FILE_TEXTS))
    # sheets' names count whatever their case; of equal ones the answer's first
    named = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys("a.tabs"), F.lower)), lambda k: F.struct(k, F.filter(F.map_entries("a.tabs"), lambda e: F.lower(e["key"]) == k)[0]["value"])))
    tabs = F.transform("bundle.tabs", lambda t: taken(F.try_element_at(named, F.lower(t["name"])), offline_tab(t), "sheet_purpose", t["name"]))
    return both.select("file", F.explode(F.concat(own, tabs)).alias("x")).select("file", "x.*")


def reconciliations(answers: DataFrame, tabs: DataFrame) -> DataFrame:
    """The claims of answers (file, answer: JSON with ``reconciliations``) that hold, in order: file, place (from 1) and their texts.

    tabs: file, name, headers, and candidates, an array of structs of source_a, source_b and cues.  A claim holds if its sheet
    is there; its two sources differ, are names or headers of that sheet and are cited from it; and a citation, or the sheet's name,
    speaks of a comparison.  Citations that the sheet does not support are left out, and so are other details.  Of equal
    claims the first holds.  All texts are compared without case and outer white space.
    """
    fold = lambda c: F.lower(F.trim(c))
    said = F.flatten(F.transform("candidates", lambda x: F.concat(F.array(x["source_a"], x["source_b"]), x["cues"])))
    allowed = F.array_distinct(F.transform(_distinct(F.concat(F.array("name"), "headers", F.coalesce(said, F.array().cast("array<string>")))), fold))
    # a file's sheets beside its answer: claims, cut out of the answer where they meet, need not move by themselves
    sheets = tabs.where("name is not null").select("file", F.struct("name", fold(F.col("name")).alias("sheet"), allowed.alias("allowed")).alias("t")).groupBy("file").agg(F.collect_list("t").alias("sheets"))
    # of sheets with one folded name the last counts
    last = F.array_sort("sheets", lambda x, y: F.when(x["name"] > y["name"], -1).when(x["name"] < y["name"], 1).otherwise(0))
    item = answers.join(sheets, "file").select("file", last.alias("sheets"), F.from_json("answer", CLAIMS).alias("a"))
    item = item.select("file", "sheets", F.posexplode("a.reconciliations").alias("at", "c")).where("c is not null")
    claim = item.select("file", "sheets", "at", *(F.trim(F.coalesce(f"c.{k}", F.lit(""))).alias(k) for k in ("worksheet", "source_a", "source_b", "matching_criteria", "tolerance", "exception_logic")), F.coalesce("c.evidence", F.array().cast("array<struct<worksheet: string, text: string>>")).alias("cited"))
    claim = claim.withColumn("sheet", fold(F.col("worksheet")))
    met = claim.withColumn("known", F.get(F.filter("sheets", lambda x: x["sheet"] == F.col("sheet")), F.lit(0))).drop("sheets").where("known is not null").select("*", "known.name", "known.allowed").drop("known")
    has = lambda c: F.array_contains("allowed", fold(c))
    kept = F.transform(F.filter("cited", lambda e: (fold(e["worksheet"]) == F.col("sheet")) & has(e["text"])), lambda e: F.trim(e["text"]))
    met = met.withColumn("evidence", F.coalesce(kept, F.array().cast("array<string>")))
    cites = lambda c: F.exists("evidence", lambda e: F.lower(e) == fold(F.col(c)))
    cue = F.exists("evidence", lambda e: contains_any(F.lower(e), COMPARED)) | contains_any(F.col("sheet"), COMPARED)
    holds = (F.col("source_a") != "") & (F.col("source_b") != "") & (fold(F.col("source_a")) != fold(F.col("source_b"))) & has(F.col("source_a")) & has(F.col("source_b")) & cites("source_a") & cites("source_b") & cue
    first = F.row_number().over(Window.partitionBy("file", "sheet", fold(F.col("source_a")), fold(F.col("source_b"))).orderBy("at"))
    good = met.where(holds).withColumn("gl_first", first).where("gl_first = 1")
    detail = lambda c: F.when(has(F.col(c)) & (F.col(c) != ""), F.col(c)).otherwise("not in the file's evidence").alias(c)
    number = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    overview = F.concat(F.col("source_a"), F.lit(" against "), F.col("source_b"))
    return good.select("file", number.alias("place"), F.col("worksheet"), overview.alias("overview"), "source_a", "source_b", *map(detail, ("matching_criteria", "tolerance", "exception_logic")), "evidence")
