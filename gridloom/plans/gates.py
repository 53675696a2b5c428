"""Evidence gates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import evidence as ev
from gridloom.plans.base import any_of, table


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", F.col("c_mktsegment"), F.when(F.pmod("c_custkey", F.lit(4)) == 0, "manual").when(F.pmod("c_custkey", F.lit(4)) == 1, "obsolete")).alias("Purpose of File"), F.array("c_name", F.lit(" "), F.col("c_nationkey").cast("string")).alias("Key Outputs"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, "c").alias("Note"))
    return ev.evidence_rows(c, "c_custkey", ["Purpose of File", "Key Outputs", "Note"])


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers' fields as evidence."""
    return _evidence(spark, d)


_EV = """ev AS (SELECT c_custkey AS entity, 'Purpose of File' AS field, c_mktsegment || CASE c_custkey % 4 WHEN 0 THEN ' manual' WHEN 1 THEN ' obsolete' ELSE '' END AS text FROM customer
 UNION ALL SELECT c_custkey, 'Key Outputs', c_name FROM customer UNION ALL SELECT c_custkey, 'Key Outputs', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'Note', 'c' FROM customer WHERE c_custkey % 3 = 0)"""
EVIDENCE_ROWS = f"WITH {_EV} SELECT * FROM ev"


def accepted_claims(spark: SparkSession, d: str) -> DataFrame:
    """Orders as claims about customers, cited by names and purposes, some of them wrongly."""
    o = table(spark, d, "orders")
    k = lambda n: F.pmod("o_orderkey", F.lit(n))
    kinds = F.array(*map(F.lit, ("duplication", "consolidation", "simplification", "automation", "retirement")))
    bases = F.array(*map(F.lit, ("No longer required", "duplicated purpose", "fully replaced")))
    c = table(spark, d, "customer").agg(F.max("c_custkey").alias("n")).first()["n"]
    peer = F.pmod(F.col("o_custkey") * 7, F.lit(c)) + 1
    claims = o.select(
        F.col("o_orderkey").alias("claim"), F.get(kinds, k(5).cast("int")).alias("kind"), F.col("o_custkey").alias("entity"), F.when(k(11) != 0, peer).alias("peer"), F.when(k(7) != 0, "x").alias("similarities"), F.lit("y").alias("differences"),
        F.when(k(6) != 0, "z").otherwise(" ").alias("shared_solution"), F.when(k(8) != 0, "do").alias("action"), F.get(bases, k(3).cast("int")).alias("basis"), F.when(k(2) == 0, "all").alias("coverage"),
    )
    at = claims.select("claim", F.explode(F.array_compact(F.array("entity", "peer"))).alias("c_custkey"))
    known = at.join(table(spark, d, "customer"), "c_custkey")
    said = F.concat_ws(" ", F.col("c_mktsegment"), F.when(F.pmod("c_custkey", F.lit(4)) == 0, "manual").when(F.pmod("c_custkey", F.lit(4)) == 1, "obsolete"))
    cite = lambda field, text: F.struct(F.lit(field).alias("field"), text.alias("text"))
    # three citations of a customer from one join
    each = F.array_compact(F.array(cite("KEY OUTPUTS", F.upper("c_name")), F.when(F.col("claim") % 13 != 0, cite("purpose of file", said)), cite("Key Outputs", F.lit("made up"))))
    citations = known.select("claim", F.col("c_custkey").alias("entity"), F.inline(each))
    return ev.accepted(claims, citations, _evidence(spark, d))


_TEXT = "c_mktsegment || CASE c_custkey % 4 WHEN 0 THEN ' manual' WHEN 1 THEN ' obsolete' ELSE '' END"
ACCEPTED_CLAIMS = f"""
WITH m AS (SELECT max(c_custkey) AS n FROM customer), cl AS (SELECT o_orderkey AS claim, ['duplication', 'consolidation', 'simplification', 'automation', 'retirement'][CAST(o_orderkey % 5 + 1 AS INT)] AS kind, o_custkey AS entity, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey * 7 % n + 1 END AS peer FROM orders, m),
abt AS (SELECT DISTINCT claim, c_custkey, c_mktsegment, {_TEXT} AS text FROM (SELECT claim, unnest([entity, peer]) AS e FROM cl) JOIN customer ON c_custkey = e),
raw AS (SELECT claim, unnest([entity, peer]) AS e FROM cl),
n AS (SELECT claim, count(*) FILTER (e IS NOT NULL) * CASE WHEN claim % 13 <> 0 THEN 2 ELSE 1 END AS n_citations FROM raw GROUP BY claim),
g AS (SELECT claim, bool_or({any_of("text", ev.MANUAL)} AND claim % 13 <> 0) AS manual FROM abt GROUP BY claim)
SELECT claim, kind, entity, peer, CAST(n_citations AS BIGINT) AS n_citations FROM cl JOIN n USING (claim) JOIN g USING (claim)
WHERE CASE kind WHEN 'duplication' THEN peer IS NOT NULL AND claim % 13 <> 0 AND claim % 7 <> 0 WHEN 'consolidation' THEN peer IS NOT NULL AND claim % 13 <> 0 AND claim % 6 <> 0 WHEN 'simplification' THEN claim % 8 <> 0 WHEN 'automation' THEN claim % 8 <> 0 AND manual
 ELSE CASE claim % 3 WHEN 0 THEN entity % 4 = 1 AND claim % 13 <> 0 WHEN 1 THEN peer IS NOT NULL ELSE peer IS NOT NULL AND claim % 2 = 0 END END
"""

QUERIES = {f.__name__: f for f in (evidence_rows, accepted_claims)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
