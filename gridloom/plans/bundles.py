"""Bundles of evidence and gates of answers over the test tables: nations or orders as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import bundles as B
from gridloom.plans.base import table


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files, their orders as sheets in the order of their keys."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    files = c.select(F.col("c_custkey").alias("file"), F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("logic_type"), F.array("c_mktsegment", F.lit("Other")).alias("logic_types"))
    heads = F.array("o_orderpriority", F.lit(" "), "o_orderpriority", F.concat(F.lit("Year "), F.year("o_orderdate").cast("string")), F.lit("Amount"), F.lit("Tax"))
    tabs = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("place"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), heads.alias("headers"), F.when(F.col("o_orderstatus") == "F", "Input").otherwise("Output").alias("category"), F.lit("data input").alias("information"), (F.col("o_orderstatus") == "P").alias("hidden"))
    return B.bundles(files, tabs)


_TABS = """o AS (SELECT o_custkey AS file, o_orderkey AS place, 'Order ' || o_orderkey AS name, [o_orderpriority, 'Year ' || year(o_orderdate), 'Amount', 'Tax'] AS headers, CASE WHEN o_orderstatus = 'F' THEN 'Input' ELSE 'Output' END AS category, 'data input' AS information, o_orderstatus = 'P' AS hidden FROM orders)"""


def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Every file's bundle as JSON."""
    return _bundles(spark, d).select("file", F.to_json("bundle").alias("bundle"))


EVIDENCE_BUNDLE = f"""
WITH {_TABS}, s AS (SELECT file, count(*) AS n, list(struct_pack(name := name, category := category, information := information, hidden := hidden, headers := headers) ORDER BY place) AS tabs FROM o GROUP BY file),
w AS (SELECT file, place, i, unnest([name] || headers) AS t, unnest(range(5)) AS k FROM (SELECT *, 0 AS i FROM o)), f AS (SELECT file, t, min((place, k)) AS spot FROM w GROUP BY file, t), e AS (SELECT file, list(t ORDER BY spot) AS said FROM f GROUP BY file)
SELECT c_custkey AS file, CAST(to_json(struct_pack(file_name := c_name, logic_type := c_mktsegment, logic_types := [c_mktsegment, 'Other'], sheet_count := coalesce(n, 0), business_evidence := coalesce(said, []), tabs := coalesce(tabs, []))) AS VARCHAR) AS bundle
FROM customer LEFT JOIN s ON s.file = c_custkey LEFT JOIN e ON e.file = c_custkey
"""


def narrative_gate(spark: SparkSession, d: str) -> DataFrame:
    """Answers for most customers: whole ones, broken ones, ones with fields empty, of another type, or about sheets that are not there."""
    bundle, k = _bundles(spark, d), F.pmod("file", F.lit(7))
    first = F.get(F.col("bundle.tabs"), F.lit(0))["name"]
    tabs = F.when(first.isNotNull(), F.map_from_arrays(F.array(F.upper(first), F.lit("Nowhere")), F.array(F.lit(" What it is for "), F.lit("x"))))
    text = lambda c: F.concat(F.lit(c + " of "), F.col("bundle.file_name"))
    good = F.to_json(F.struct(text("purpose").alias("purpose"), F.when(k != 1, text("outcome")).alias("outcome"), F.when(k == 2, F.lit("  ")).otherwise(text("process")).alias("process"), F.lit("s").alias("sub_process"), F.when(k != 3, tabs).alias("tabs")))
    answers = bundle.where(k != 6).select("file", F.when(k == 4, "no JSON at all").when(k == 5, '{"purpose": {"a": 1}, "process": "p", "tabs": [1, 2]}').otherwise(good).alias("answer"))
    return B.narrated(bundle, answers)


NARRATIVE_GATE = f"""
WITH {_TABS}, c AS (SELECT c_custkey AS file, c_name, c_custkey % 7 AS k, CASE WHEN c_custkey % 7 = 6 THEN 'drafted' ELSE 'drafted: offline fallback' END AS fallen FROM customer),
x AS (SELECT file, fallen, 'purpose' AS field, NULL::VARCHAR AS sheet, CASE WHEN k < 4 THEN 'purpose of ' || c_name END AS said, 'not established: ask the owner what the file is for' AS offline FROM c
 UNION ALL SELECT file, fallen, 'outcome', NULL, CASE WHEN k < 4 AND k <> 1 THEN 'outcome of ' || c_name END, 'not established: ask who uses its result' FROM c
 UNION ALL SELECT file, fallen, 'process', NULL, CASE WHEN k < 4 AND k <> 2 THEN 'process of ' || c_name WHEN k = 5 THEN 'p' END, 'not established: ask the owner' FROM c
 UNION ALL SELECT file, fallen, 'sub_process', NULL, CASE WHEN k < 4 THEN 's' END, 'not established: ask the owner' FROM c
 UNION ALL SELECT c.file, fallen, 'sheet_purpose', name, CASE WHEN k < 3 AND place = min(place) OVER (PARTITION BY c.file) THEN 'What it is for' END, category || ' sheet, ' || information || ': ' || array_to_string(headers, ', ') || CASE WHEN hidden THEN ' (hidden)' ELSE '' END FROM c JOIN o USING (file))
SELECT file, field, sheet, coalesce(said, offline) AS text, CASE WHEN said IS NULL THEN fallen ELSE 'inferred' END AS basis FROM x
"""


def reconciliation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files with one sheet; every line claims a reconciliation, some on no sheet, of equal, made up or uncited sources."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Recon "), k.cast("string"))).otherwise(F.concat(F.lit("Check "), k.cast("string")))
    heads = F.array_compact(F.array("o_orderpriority", F.concat(F.lit("Status "), F.col("o_orderstatus")), F.when(k % 3 == 0, "Variance"), F.lit(""), F.lit("Limit")))
    tabs = o.select(k.alias("file"), name.alias("name"), heads.alias("headers"), F.array(F.struct(F.lit("Ledger").alias("source_a"), F.lit("Bank").alias("source_b"), F.array(F.lit("agreed")).alias("cues"))).alias("candidates"))
    # an order's lines as numbers; its claims are made of them where they have met the order
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    joined = lines.join(o.withColumn("name", name).withColumn("o_clerk", F.lit("nowhere")), F.col("l_orderkey") == k)
    status = F.concat(F.lit(" STATUS "), F.col("o_orderstatus"), F.lit(" "))
    cite = lambda text, sheet="name": F.struct(F.upper(sheet).alias("worksheet"), text.alias("text"))

    def claim(line: Column) -> Column:
        n, p = line["l_linenumber"], line["l_partkey"]
        source = F.when(n % 4 == 0, F.upper("o_orderpriority")).when(n % 4 == 3, "made up").otherwise(status)
        cites = F.array_compact(F.array(cite(F.lower("o_orderpriority")), F.when(p % 3 != 0, cite(status)), cite(F.lit("variance ")), F.when(p % 5 == 0, cite(F.lit("Agreed"))), cite(F.lit("Bank"), "o_clerk"), cite(F.lit("other"))))
        return F.struct(F.when(n % 5 == 0, "nowhere").otherwise(F.upper("name")).alias("worksheet"), F.lower("o_orderpriority").alias("source_a"), source.alias("source_b"), F.when(p % 2 == 0, "LIMIT").otherwise("none").alias("matching_criteria"), F.when(p % 7 == 0, "bank").alias("tolerance"), cites.alias("evidence"))

    answers = joined.select(k.alias("file"), F.to_json(F.struct(F.transform("lines", claim).alias("reconciliations"))).alias("answer"))
    # answers that are none
    answers = answers.withColumn("answer", F.when(F.col("file") % 11 == 0, F.concat(F.lit("Here it is: "), "answer")).when(F.col("file") % 13 == 0, '{"reconciliations": "none"}').otherwise(F.col("answer")))
    out = B.reconciliations(answers, tabs)
    return out.select("file", "place", "worksheet", "overview", "matching_criteria", "tolerance", "exception_logic", F.array_join("evidence", "|").alias("evidence"))


RECONCILIATION_GATE = f"""
WITH x AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 4 = 0 THEN 'RECON ' ELSE 'CHECK ' END || o_orderkey AS worksheet, lower(o_orderpriority) AS a, 'STATUS ' || o_orderstatus AS b, o_orderkey % 3 = 0 AS v, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n, p, s) AS r FROM x WHERE n % 5 <> 0 AND n % 4 IN (1, 2) AND p % 3 <> 0 AND (v OR file % 4 = 0 OR p % 5 = 0) AND file % 11 <> 0 AND file % 13 <> 0)
SELECT file, CAST(r AS INT) AS place, worksheet, a || ' against ' || b AS overview, CASE WHEN p % 2 = 0 THEN 'LIMIT' ELSE 'not in the file''s evidence' END AS matching_criteria, CASE WHEN p % 7 = 0 THEN 'bank' ELSE 'not in the file''s evidence' END AS tolerance, 'not in the file''s evidence' AS exception_logic,
 a || '|' || b || CASE WHEN v THEN '|variance' ELSE '' END || CASE WHEN p % 5 = 0 THEN '|Agreed' ELSE '' END AS evidence FROM h WHERE r = 1
"""

QUERIES = {f.__name__: f for f in (evidence_bundle, narrative_gate, reconciliation_gate)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
