"""Evidence gates: claims count only as far as their citations match what the files say.

evidence: entity, field, text.  claims: claim, kind, entity, peer (null for claims about
one file), similarities, differences, shared_solution, action, basis, coverage.
citations: claim, entity, field, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import contains_any

#: Fields that describe the business use of a file, those of its outputs, and cue words: fixed values.
BUSINESS = ("purpose of file", "key output / outcome", "key inputs", "key outputs", "key calculations / logic")
OUTPUTS = ("key output / outcome", "key outputs")
MANUAL = ("manual", "paste", "override", "keyed", "hardcode", "hard-coded")
RETIRED = ("no longer required", "discontinued", "obsolete", "retired")


def evidence_rows(wide: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """entity, field, text: every filled field of a wide row, each item of its lists by itself."""
    kinds = dict(wide.dtypes)
    item = lambda f: F.transform(F.col(f) if kinds[f].startswith("array") else F.array(f), lambda x: F.struct(F.lit(f).alias("field"), F.trim(x.cast("string")).alias("text")))
    none = F.array().cast("array<struct<field:string,text:string>>")
    every = F.flatten(F.array(*(F.coalesce(item(f), none) for f in fields)))
    return wide.select(F.col(entity).alias("entity"), F.explode(every).alias("x")).select("entity", "x.*").where("text <> ''")


def valid_citations(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of a claim's own files that match their evidence, letters in either case."""
    # both sides meet by the claim alone, by which what follows is grouped
    about = claims.groupBy("claim").agg(F.flatten(F.collect_set(F.array_compact(F.array("entity", "peer")))).alias("gl_about"))
    fold = lambda df: df.withColumn("gl_field", F.lower("field")).withColumn("gl_text", F.lower("text"))
    known = fold(citations).drop("field", "text").join(fold(evidence).select("entity", "gl_field", "gl_text"), ["entity", "gl_field", "gl_text"], "left_semi")
    return known.join(about, "claim").where(F.array_contains("gl_about", F.col("entity"))).drop("gl_about")


def accepted(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims that hold, with the number of citations kept.

    duplication and consolidation: both files cited, both by business fields, two such fields at least, and the
    similarities and differences, or the shared solution, stated; simplification: a citation and an action;
    automation: also a manual cue in a citation; retirement: said by the file itself, or its purpose duplicated or
    fully replaced with both files' outputs cited.
    """
    valid = valid_citations(claims, citations, evidence).withColumn("gl_business", F.col("gl_field").isin(list(BUSINESS)))
    when = lambda test, c: F.collect_set(F.when(test, F.col(c)))
    agg = valid.groupBy("claim").agg(
        F.count("*").alias("n_citations"),
        when(F.lit(True), "entity").alias("cited"),
        when(F.col("gl_business"), "entity").alias("sources"),
        when(F.col("gl_business"), "gl_field").alias("fields"),
        when(F.col("gl_field").isin(list(OUTPUTS)), "entity").alias("output_sources"),
        F.max(contains_any(F.col("gl_text"), MANUAL)).alias("manual"),
        when(contains_any(F.col("gl_text"), RETIRED), "entity").alias("retired"),
    )
    both = lambda c: F.array_contains(c, F.col("entity")) & F.array_contains(c, F.col("peer"))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    business = both("cited") & both("sources") & (F.size("fields") >= 2)
    kind = F.col("kind")
    holds: Column = (
        F.when(kind == "duplication", business & filled("similarities") & filled("differences"))
        .when(kind == "consolidation", business & filled("shared_solution"))
        .when(kind == "simplification", filled("action"))
        .when(kind == "automation", filled("action") & F.col("manual"))
        .when(
            kind == "retirement",
            ((F.lower("basis") == "no longer required") & F.array_contains("retired", F.col("entity")))
            | ((F.lower("basis") == "duplicated purpose") & both("cited"))
            | ((F.lower("basis") == "fully replaced") & both("cited") & both("output_sources") & filled("coverage")),
        )
    )
    return claims.join(agg, "claim").where(F.coalesce(holds, F.lit(False))).select("claim", "kind", "entity", "peer", "n_citations")
