"""The operators of this subpackage bound to their tables, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, filter_audit, langid, lexical, licenses, mixing, pii, quality, secrets, simhash, token_files, tokens, url_filter
from gridloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """One query an operator, with production parameters."""
    docs = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_decontamination": lambda spark, d: decontaminate.report(docs(spark, d), table(spark, d, "benchmark")),
        "op2_url_filter": lambda spark, d: url_filter.judge(table(spark, d, "pages")),
        "op3_license_scan": lambda spark, d: licenses.report(docs(spark, d)),
        "op4_pii": lambda spark, d: pii.report(docs(spark, d)),
        "op5_secret_scan": lambda spark, d: secrets.report(docs(spark, d)),
        "op6_token_count": lambda spark, d: tokens.report(docs(spark, d)),
        "op7_quality": lambda spark, d: quality.report(docs(spark, d)),
        "op8_mixing": lambda spark, d: mixing.report(docs(spark, d)),
        "op9_language": lambda spark, d: langid.report(docs(spark, d)),
        "op10_simhash": lambda spark, d: simhash.report(docs(spark, d)),
        "op11_token_files": lambda spark, d: token_files.report(docs(spark, d)),
        "op12_filter_audit": lambda spark, d: filter_audit.report(docs(spark, d), table(spark, d, "labels")),
        "op13_lexical_search": lambda spark, d: lexical.report(docs(spark, d), table(spark, d, "benchmark")),
    }
