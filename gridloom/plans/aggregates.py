"""Roll-ups, profiles and incremental selection over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import joins, profiles, rollups
from gridloom.plans.base import case, table, tasks
from gridloom.storage import shared_folder
from gridloom.streaming import changes

_AREA = ("final output", "input", "control / check")


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Error events with a type, an area and a file."""
    e = table(spark, d, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.get(F.array(*map(F.lit, ("#REF!", "#N/A", "#DIV/0!", "#VALUE!"))), F.pmod(k, F.lit(4)))
    area = F.get(F.array(*map(F.lit, _AREA)), F.pmod("event_id", F.lit(3)).cast("int"))
    return e.select("event_id", F.col("user_id").alias("file"), kind.alias("error"), area.alias("area"), (F.pmod(k, F.lit(5)) + 1).cast("long").alias("n"))


_ERRORS = """errors AS (SELECT event_id, user_id AS file, ['#REF!', '#N/A', '#DIV/0!', '#VALUE!'][CAST(props->>'$.k' AS INT) % 4 + 1] AS error,
 ['final output', 'input', 'control / check'][CAST(event_id % 3 + 1 AS INT)] AS area, CAST(CAST(props->>'$.k' AS INT) % 5 + 1 AS BIGINT) AS n FROM events WHERE event_type = 'error')"""
_SEVERITY = "CASE WHEN area = 'final output' OR error = '#REF!' THEN 'High' ELSE 'Medium' END"


def error_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Errors by type and area: files, cells and severity, the severe first."""
    return rollups.error_rollup(_errors(spark, d), "error", "area", "file", "n")


ERROR_ROLLUP = f"WITH {_ERRORS} SELECT error AS error_type, area AS area_type, count(DISTINCT file) AS files, CAST(sum(n) AS BIGINT) AS cells, {_SEVERITY} AS severity FROM errors GROUP BY ALL"


def error_groups(spark: SparkSession, d: str) -> DataFrame:
    """Errors per file and type with their first cells."""
    out = rollups.error_groups(_errors(spark, d), ["file", "error"], ["event_id"], "event_id")
    return out.select("file", "error", "count", F.array_join("sample_cells", ",").alias("samples"))


ERROR_GROUPS = f"WITH {_ERRORS} SELECT file, error, count(*) AS count, array_to_string(list(event_id ORDER BY event_id)[1:25], ',') AS samples FROM errors GROUP BY file, error"


def error_details(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample cell of the error groups by type and area."""
    return rollups.error_details(rollups.error_groups(_errors(spark, d), ["error", "area"], ["n", "event_id"], "event_id"), ["error", "area"])


ERROR_DETAILS = f"WITH {_ERRORS} SELECT error, area, unnest(list(event_id ORDER BY n, event_id)[1:25]) AS cell FROM errors GROUP BY error, area"


def downstream_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The first eight users behind each error type and area, as outputs."""
    e = _errors(spark, d).withColumn("outputs", F.array(F.lpad(F.col("file").cast("string"), 8, "0"), F.lit("x")))
    return rollups.downstream(e, ["error", "area"], "outputs").select("error", "area", F.array_join("downstream", ",").alias("downstream"))


DOWNSTREAM_OUTPUTS = f"WITH {_ERRORS} SELECT error, area, array_to_string(list_sort(list_distinct(list(lpad(CAST(file AS VARCHAR), 8, '0')) || ['x']))[1:8], ',') AS downstream FROM errors GROUP BY error, area"


def hidden_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts as hidden sheets by purpose; their line items' suppliers depend on them."""
    p = table(spark, d, "part")
    lead = F.get(F.array(*map(F.lit, ("raw ", "calc ", "xref ", "qa ", "pack ", "", ""))), F.pmod("p_partkey", F.lit(7)).cast("int"))
    roles = F.when(F.pmod("p_partkey", F.lit(11)) == 0, F.array(F.lit("Output"))).otherwise(F.array().cast("array<string>"))
    name = F.concat(lead, "p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    readers = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.col("l_suppkey")).alias("readers"))
    sheets = p.join(readers, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_brand",
        name.alias("name"),
        rollups.hidden_purpose(name, roles, F.col("p_size"), F.pmod("p_size", F.lit(2))).alias("purpose"),
        F.coalesce("readers", F.array().cast("array<bigint>")).alias("readers"),
    )
    out = rollups.hidden_groups(sheets, ["p_brand", "purpose"])
    return out.select("p_brand", "purpose", "count", F.array_join("sheets", ";").alias("sheets"), F.array_join("depended_on_by", ",").alias("depended_on_by"))


HIDDEN_GROUPS = f"""
WITH s AS (SELECT p_partkey, p_brand, p_size, ['raw ', 'calc ', 'xref ', 'qa ', 'pack ', '', ''][CAST(p_partkey % 7 + 1 AS INT)] || p_name || ' ' || p_partkey AS name FROM part),
g AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'Output' ELSE {case("lower(name)", rollups.PURPOSES, "CASE WHEN p_size > 0 AND p_size % 2 = 0 THEN 'Supporting' ELSE 'Unknown' END")} END AS purpose FROM s),
r AS (SELECT DISTINCT p_brand, purpose, l_suppkey FROM g JOIN lineitem ON l_partkey = p_partkey)
SELECT p_brand, purpose, count(*) AS count, string_agg(DISTINCT name, ';' ORDER BY name) AS sheets,
 coalesce((SELECT string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) FROM r WHERE r.p_brand = g.p_brand AND r.purpose = g.purpose), '') AS depended_on_by
FROM g GROUP BY p_brand, purpose
"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("full")
    return o.select(F.col("o_orderkey").alias("file"), status.alias("status"), F.when(status == "failed", F.col("o_orderpriority")).otherwise("").alias("category"), F.pmod("o_custkey", F.lit(4)).alias("errors"), F.pmod("o_orderkey", F.lit(3)).alias("hidden"))


_FILES = "files AS (SELECT o_orderkey AS file, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial' ELSE 'full' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS category, o_custkey % 4 AS errors, o_orderkey % 3 AS hidden FROM orders)"


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Files by scan status and reason."""
    return rollups.coverage(_files(spark, d), "status", "category")


COVERAGE = f"WITH {_FILES} SELECT status AS parse_status, category, count(*) AS files FROM files GROUP BY ALL"


def overview(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all files."""
    return rollups.overview(_files(spark, d), "status", "errors", "hidden")


OVERVIEW = f"WITH {_FILES} SELECT count(*) AS files, count(*) FILTER (status <> 'failed') AS scanned, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(hidden) AS BIGINT) AS hidden FROM files"


def _cells(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    """Line items as long cells: sheets of orders, one column per field; ``by``: line items dealt by that column, before they are five cells each."""
    li = table(spark, d, "lineitem")
    # with a number given, small parts are not joined up: five cells each take more memory than they move
    li = (li if by is None else li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by)).withColumn("sheet", F.floor(F.col("l_orderkey") / 50))
    gap = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3, F.lit(5)) == 0
    cell = lambda c, text, number, date: F.struct(F.lit(c).alias("col"), text.cast("string").alias("text"), F.lit(number).alias("is_number"), F.lit(date).alias("is_date"))
    values = F.array(cell(1, F.col("l_returnflag"), False, False), cell(2, F.col("l_linenumber"), True, False), cell(3, F.date_format("l_shipdate", "yyyy-MM-dd"), False, True), cell(4, F.when(gap, F.lit(None)).otherwise(F.col("l_linestatus")), False, False), cell(5, F.when(gap, F.col("l_returnflag")).otherwise(F.col("l_suppkey").cast("string")), True, False))
    return li.select("sheet", "l_orderkey", "l_linenumber", "l_partkey", F.explode(values).alias("c")).select("sheet", "l_orderkey", "l_linenumber", "l_partkey", "c.*").where("text is not null")


_CELLS = """li AS (SELECT *, l_orderkey // 50 AS sheet, (l_orderkey * 7 + l_linenumber * 3) % 5 = 0 AS gap FROM lineitem),
cells AS (SELECT sheet, l_orderkey, l_linenumber, l_partkey, unnest([1, 2, 3, 4, 5]) AS col,
 unnest([l_returnflag, CAST(l_linenumber AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d'), CASE WHEN gap THEN NULL ELSE l_linestatus END, CASE WHEN gap THEN l_returnflag ELSE CAST(l_suppkey AS VARCHAR) END]) AS text,
 unnest([false, true, false, false, true]) AS is_number, unnest([false, false, true, false, false]) AS is_date FROM li)"""


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Type, nulls and distinct values of the columns of line item sheets, empty ones included."""
    cells = _cells(spark, d)
    rows = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 50).alias("sheet")).agg(F.count("*").alias("n_rows"))
    plain = cells.join(rows, "sheet").select("sheet", "col", "n_rows", "text", (~F.col("is_number") & ~F.col("is_date")).alias("is_text"), "is_number", "is_date", F.lit(False).alias("is_error"), (F.col("col") == 2).alias("is_formula"))
    out = profiles.column_profile(plain, ["sheet"], "col")
    return profiles.with_empty_columns(out, rows.select("sheet", F.lit(1).alias("left"), F.lit(6).alias("right")), ["sheet"], "col")


COLUMN_PROFILE = f"""
WITH {_CELLS}, n AS (SELECT sheet, count(*) AS n_rows FROM li GROUP BY sheet),
p AS (SELECT sheet, col, count(*) AS n_cells, CASE col WHEN 3 THEN 'date' WHEN 2 THEN 'number' WHEN 5 THEN 'number' ELSE 'text' END AS inferred_type,
 round(1 - count(*) / max(n_rows), 3) AS null_rate, round(count(DISTINCT text) / count(text), 3) AS distinct_ratio, count(*) FILTER (col = 2) AS formula_cells, CAST(0 AS BIGINT) AS error_cells
 FROM cells JOIN n USING (sheet) WHERE text IS NOT NULL GROUP BY sheet, col)
SELECT sheet, col, coalesce(n_cells, 0) AS n_cells, coalesce(inferred_type, 'empty') AS inferred_type, coalesce(null_rate, 1.0) AS null_rate, coalesce(distinct_ratio, 0.0) AS distinct_ratio, coalesce(formula_cells, 0) AS formula_cells, coalesce(error_cells, 0) AS error_cells
FROM (SELECT sheet, unnest([1, 2, 3, 4, 5, 6]) AS col FROM n) LEFT JOIN p USING (sheet, col)
"""


def row_profile(spark: SparkSession, d: str) -> DataFrame:
    """Shares of text, style and formulas of each row of the sheets."""
    cells = _cells(spark, d, "l_orderkey").select("sheet", "l_orderkey", "text", (~F.col("is_number") & ~F.col("is_date")).alias("is_text"), (F.col("col") <= 2).alias("is_styled"), (F.col("col") == 2).alias("is_formula"), F.lit(40).alias("width"))
    out = profiles.row_profile(cells, ["sheet"], "l_orderkey")
    return out.select("sheet", "l_orderkey", "n", *(F.round(c, 6).alias(c) for c in ("text_ratio", "styled", "distinct", "density", "formula_ratio")))


ROW_PROFILE = f"""
WITH {_CELLS} SELECT sheet, l_orderkey, count(*) AS n, round(avg(CAST(NOT is_number AND NOT is_date AS DOUBLE)), 6) AS text_ratio, round(avg(CAST(col <= 2 AS DOUBLE)), 6) AS styled,
 round(CAST(count(DISTINCT text) AS DOUBLE) / count(*), 6) AS distinct, round(count(*) / 40.0::DOUBLE, 6) AS density, round(avg(CAST(col = 2 AS DOUBLE)), 6) AS formula_ratio FROM cells WHERE text IS NOT NULL GROUP BY sheet, l_orderkey
"""


def occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the upper left corner of sheets, cut at 20 rows and 4 columns."""
    c = _cells(spark, d).select("sheet", (F.pmod("l_orderkey", F.lit(50)) + 1).alias("row"), "col", (F.col("col") == 4).alias("is_error"), (F.col("col") == 2).alias("is_formula"), (F.col("col") == 1).alias("is_text")).distinct()
    out = profiles.occupancy(c, ["sheet"], 20, 4)
    return out.select("sheet", F.array_join(F.transform("occupancy", lambda x: F.concat_ws(":", x["r"], x["c"], x["flag"])), ",").alias("cells"), "truncated")


OCCUPANCY = f"""
WITH {_CELLS}, x AS (SELECT DISTINCT sheet, l_orderkey % 50 + 1 AS r, col FROM cells WHERE text IS NOT NULL)
SELECT sheet, coalesce(string_agg(r || ':' || col || ':' || CASE col WHEN 4 THEN 3 WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 1 END, ',' ORDER BY r, col) FILTER (r <= 20 AND col <= 4), '') AS cells, bool_or(NOT (r <= 20 AND col <= 4)) AS truncated FROM x GROUP BY sheet
"""


def formula_profile(spark: SparkSession, d: str) -> DataFrame:
    """Line items as formulas: shapes, volatile, cross-sheet, external and literal counts per supplier."""
    li = table(spark, d, "lineitem")
    f = li.select("l_suppkey", F.concat_ws("/", "l_returnflag", "l_linestatus", F.pmod("l_partkey", F.lit(9)).cast("string")).alias("skeleton"), (F.col("l_linenumber") == 1).alias("is_volatile"), (F.col("l_discount") > 0.05).alias("is_cross"), (F.col("l_tax") > 0.07).alias("is_external"), (F.col("l_quantity") > 25).alias("has_literal"))
    return profiles.formula_profile(f, ["l_suppkey"])


FORMULA_PROFILE = """
SELECT l_suppkey, count(*) AS total, count(DISTINCT l_returnflag || '/' || l_linestatus || '/' || l_partkey % 9) AS distinct_skeletons, count(*) FILTER (l_linenumber = 1) AS volatile_count, count(*) FILTER (l_discount > 0.05) AS cross_sheet_count,
 count(*) FILTER (l_tax > 0.07) AS external_count, count(*) FILTER (l_quantity > 25) AS hardcoded_literal_count, round(count(*) / count(DISTINCT l_returnflag || '/' || l_linestatus || '/' || l_partkey % 9), 1) AS compression FROM lineitem GROUP BY l_suppkey
"""


def top_functions(spark: SparkSession, d: str) -> DataFrame:
    """The twelve most frequent brands per supplier, as functions; ties by the first order."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return profiles.top_items(li, ["l_suppkey"], "p_brand", "l_orderkey", 12)


TOP_FUNCTIONS = """
WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n, min(l_orderkey) AS first_seen FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_suppkey, p_brand, n, first_seen, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first_seen, p_brand) AS place FROM c) WHERE place <= 12
"""


def complexity(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as workbooks: totals over their line items and the complexity rules."""
    li = table(spark, d, "lineitem")
    sheets = li.groupBy(F.col("l_suppkey").alias("file"), "l_linenumber", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("cells"), F.count("*").alias("formulas"), F.count_distinct("l_tax").alias("distinct_skeletons"), F.count_if(F.col("l_discount") > 0.05).alias("cross_sheet"), F.count_if(F.col("l_quantity") > 40).alias("hardcoded"), F.count_if(F.col("l_tax") > 0.07).alias("volatile"))
    t = profiles.totals(sheets, "file")
    out = t.select("*", F.pmod("file", F.lit(6)).alias("links"), (F.pmod("file", F.lit(2)) == 0).alias("has_vba"), (F.pmod("file", F.lit(5)) == 0).alias("has_power_query"))
    out = profiles.complexity(out)
    return out.select("file", "cells", "formulas", "distinct_skeletons", "n_sheets", "non_formula_cells", "score", "complexity", "confidence", F.array_join("evidence", "; ").alias("evidence"))


COMPLEXITY = """
WITH s AS (SELECT l_suppkey AS file, l_linenumber, l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS cells, count(*) AS formulas, count(DISTINCT l_tax) AS shapes FROM lineitem GROUP BY ALL),
t AS (SELECT file, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(formulas) AS BIGINT) AS formulas, CAST(sum(shapes) AS BIGINT) AS shapes, count(*) AS n_sheets, file % 6 AS links, file % 2 = 0 AS vba, file % 5 = 0 AS pq FROM s GROUP BY file),
p AS (SELECT *, CASE WHEN cells > 20000 THEN 2 WHEN cells > 2000 THEN 1 ELSE 0 END AS a, CASE WHEN formulas > 5000 OR shapes > 60 THEN 2 WHEN formulas > 200 OR shapes > 15 THEN 1 ELSE 0 END AS b, CASE WHEN links > 3 THEN 2 WHEN links >= 1 THEN 1 ELSE 0 END AS c FROM t),
q AS (SELECT *, a + b + c + CAST(n_sheets > 12 AS INT) + 2 * CAST(vba AS INT) + CAST(pq AS INT) AS score FROM p)
SELECT file, cells, formulas, shapes AS distinct_skeletons, n_sheets, cells - formulas AS non_formula_cells, score, CASE WHEN score >= 5 THEN 'High' WHEN score >= 2 THEN 'Medium' ELSE 'Low' END AS complexity,
 least(0.9, round(0.6 + 0.1 * least(3.0, abs(score - 3.5)), 2)) AS confidence,
 concat_ws('; ', CASE WHEN cells > 0 THEN 'cells: ' || cells || ' (+' || a || ')' END, CASE WHEN formulas > 0 THEN 'formulas: ' || formulas || ' (+' || b || ')' END, CASE WHEN shapes > 0 THEN 'shapes: ' || shapes || ' (+' || b || ')' END,
  CASE WHEN links > 0 THEN 'links: ' || links || ' (+' || c || ')' END, CASE WHEN n_sheets > 12 THEN 'sheets: ' || n_sheets || ' (+1)' END, CASE WHEN vba THEN 'macros (+2)' END, CASE WHEN pq THEN 'queries (+1)' END) AS evidence FROM q
"""


def cell_regions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as cells in rectangles of parts: the first by its top row."""
    li = table(spark, d, "lineitem")
    points = li.select(F.pmod("l_suppkey", F.lit(4)).alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"))
    return joins.cell_regions(points, _boxes(spark, d), ["sheet"], ["top", "id"], once=tasks(li)).select("sheet", "row", "col", F.col("box.id").alias("region"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    top = F.col("p_partkey") * 37
    return p.select(F.pmod("p_partkey", F.lit(4)).alias("sheet"), F.col("p_partkey").alias("id"), top.alias("top"), (top + F.col("p_size") * 3).alias("bottom"), F.pmod("p_partkey", F.lit(5)).alias("left"), (F.pmod("p_partkey", F.lit(5)) + 2).alias("right"))


_BOXES = "boxes AS (SELECT p_partkey % 4 AS sheet, p_partkey AS id, p_partkey * 37 AS top, p_partkey * 37 + p_size * 3 AS bottom, p_partkey % 5 AS lft, p_partkey % 5 + 2 AS rgt FROM part)"
CELL_REGIONS = f"""
WITH {_BOXES}, points AS (SELECT DISTINCT l_suppkey % 4 AS sheet, l_orderkey AS r, l_linenumber AS c FROM lineitem)
SELECT p.sheet, p.r AS row, p.c AS col, arg_min(b.id, b.top) AS region FROM points p LEFT JOIN boxes b ON p.sheet = b.sheet AND p.r BETWEEN b.top AND b.bottom AND p.c BETWEEN b.lft AND b.rgt GROUP BY ALL
"""


def unclaimed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that lie in no rectangle."""
    points = table(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(4)).alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).distinct()
    return joins.unclaimed(points, _boxes(spark, d), ["sheet"])


UNCLAIMED_CELLS = f"""
WITH {_BOXES}, points AS (SELECT DISTINCT l_suppkey % 4 AS sheet, l_orderkey AS r, l_linenumber AS c FROM lineitem)
SELECT sheet, r AS row, c AS col FROM points p WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE p.sheet = b.sheet AND p.r BETWEEN b.top AND b.bottom AND p.c BETWEEN b.lft AND b.rgt)
"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Labels as citations of documents: entity, language in either case, and length must match."""
    docs = table(spark, d, "documents")
    cited = table(spark, d, "labels").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").select(F.col("doc_id").alias("entity"), F.when(F.col("quality") == 1, F.upper("lang")).otherwise("xx").alias("field"), F.col("n_chars").cast("string").alias("text"), "toxic")
    known = docs.select(F.col("doc_id").alias("entity"), F.col("lang").alias("field"), F.col("n_chars").cast("string").alias("text"))
    return joins.citations(cited, known).select("entity", "field", "text", "toxic")


CITATIONS = "SELECT d.doc_id AS entity, upper(lang) AS field, CAST(n_chars AS VARCHAR) AS text, toxic FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1"


def incremental(spark: SparkSession, d: str) -> DataFrame:
    """Orders to scan again: new ones, changed ones, and those that failed before."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"), F.sha2(F.col("o_orderpriority"), 256).alias("sha"), "o_orderstatus", "o_orderdate")
    previous = o.where("o_orderdate < DATE '1996-01-01'").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha", (F.col("o_orderstatus") == "F").alias("failed"))
    return joins.changed(o, previous, "o_orderkey", ["size", "sha"], "failed").select("o_orderkey", F.substring("sha", 1, 12).alias("sha"))


INCREMENTAL = "SELECT o_orderkey, substr(sha256(o_orderpriority), 1, 12) AS sha FROM orders WHERE NOT (o_orderdate < DATE '1996-01-01' AND o_orderkey % 5 <> 0 AND o_orderstatus <> 'F')"


def streamed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of files, a user a path and an error its end: what a stream with state by path leaves there."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    log = e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("version"), F.when(F.col("event_type") != "error", F.sha2(F.concat_ws(":", "event_type", F.floor("value").cast("long")), 256)).alias("sha"))
    out = f"{shared_folder(spark)}/gridloom-spool/changes-{uuid.uuid4().hex}"
    sink = changes.changes(log).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    sink.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/change/batch={number}")).start().awaitTermination()
    return changes.live(spark.read.parquet(f"{out}/change")).select("path", F.substring("sha", 1, 12).alias("sha"))


STREAMED_CHANGES = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id, CASE WHEN event_type <> 'error' THEN substr(sha256(event_type || ':' || CAST(floor(value) AS BIGINT)), 1, 12) END AS sha FROM events WHERE user_id IS NOT NULL),
l AS (SELECT path, sha FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY event_id DESC) = 1) SELECT path, sha FROM l WHERE sha IS NOT NULL
"""


def remaining_children(spark: SparkSession, d: str) -> DataFrame:
    """Line items of orders that still exist, after a merge of new orders over old ones."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    # high and urgent orders come again, with another status
    again = o.where(F.substring("o_orderpriority", 1, 1) <= "2").withColumn("o_orderstatus", F.lit("N"))
    merged = joins.upsert(o, again, "o_orderkey").select("o_orderkey", "o_orderstatus")
    left = joins.still_there(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), merged, "o_orderkey")
    return left.join(merged, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


REMAINING_CHILDREN = "SELECT CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 'N' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


def selected_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers chosen by id, in the order given, each once."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("file_name"))
    return joins.selected(c, [9, 3, 77, 3, 12, 9_999_999], "c_custkey")


SELECTED_FILES = "SELECT c_custkey, c_name AS file_name, list_position([9, 3, 77, 12, 9999999], c_custkey) AS place FROM customer WHERE c_custkey IN (9, 3, 77, 12, 9999999)"


def portfolio_findings(spark: SparkSession, d: str) -> DataFrame:
    """Errors, hidden sheets, reviews and coverage as one table of findings."""
    errors = rollups.error_rollup(_errors(spark, d), "error", "area", "file", "n")
    files = _files(spark, d)
    text = lambda *x: F.concat_ws(" ", *(v if not isinstance(v, str) else F.lit(v) for v in x))
    review = files.where("hidden > 0").agg(F.count("*").alias("f"), F.coalesce(F.sum("hidden"), F.lit(0)).alias("n"))
    failed = files.agg(F.count_if(F.col("status") == "failed").alias("n"))
    level = F.lit("Medium")
    return rollups.findings(
        [
            rollups.finding(errors, "errors", text(F.col("error_type"), "in", F.col("area_type")), F.col("severity"), F.col("files"), F.col("cells")),
            rollups.finding(files.groupBy("category").agg(F.count("*").alias("f"), F.sum("errors").alias("n")), "reasons", F.col("category"), level, F.col("f"), F.col("n")),
            rollups.finding(review, "review", F.lit("hidden sheets to review"), level, F.col("f"), F.col("n")),
            rollups.finding(failed, "coverage", F.lit("files not read"), F.when(F.col("n") > 0, "High").otherwise("Medium"), F.col("n"), F.col("n")),
        ]
    )


PORTFOLIO_FINDINGS = f"""
WITH {_ERRORS}, {_FILES}
SELECT 'errors' AS category, error || ' in ' || area AS finding, {_SEVERITY} AS severity, count(DISTINCT file) AS files, CAST(sum(n) AS BIGINT) AS affected FROM errors GROUP BY error, area
UNION ALL SELECT 'reasons', category, 'Medium', count(*), CAST(sum(errors) AS BIGINT) FROM files GROUP BY category
UNION ALL SELECT 'review', 'hidden sheets to review', 'Medium', count(*), CAST(coalesce(sum(hidden), 0) AS BIGINT) FROM files WHERE hidden > 0
UNION ALL SELECT 'coverage', 'files not read', CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'High' ELSE 'Medium' END, count(*) FILTER (status = 'failed'), count(*) FILTER (status = 'failed') FROM files
"""


def assessment_long(spark: SparkSession, d: str) -> DataFrame:
    """Wide customer rows as long fields in schema order."""
    from gridloom.sinks.tables import long_fields

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("business_area"), F.format_string("%.2f", "c_acctbal").alias("complexity"))
    return long_fields(c, "file", ["complexity", "file_name", "business_area"])


ASSESSMENT_LONG = """
SELECT c_custkey AS file, unnest([1, 2, 3]) AS position, unnest(['complexity', 'file_name', 'business_area']) AS field, unnest([printf('%.2f', c_acctbal), c_name, c_mktsegment]) AS value FROM customer
"""


def pair_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Supplier pairs in orders by relationship: pairs and distinct files."""
    return rollups.pair_rollup(_pairs(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    # line items move once, by order; then each pair of suppliers has one row with both kinds, whose key is two numbers
    of = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct("l_suppkey", "l_returnflag")).alias("s"))
    one = of.select("s", F.explode("s").alias("a"))
    met = one.select("a", F.explode(F.filter("s", lambda x: x["l_suppkey"] > F.col("a.l_suppkey"))).alias("b"))
    same = F.coalesce(F.col("a.l_returnflag") == F.col("b.l_returnflag"), F.lit(False))
    pairs = met.groupBy(F.col("a.l_suppkey").alias("file_a"), F.col("b.l_suppkey").alias("file_b")).agg(F.bool_or(same).alias("same"), F.bool_or(~same).alias("other"))
    kinds = F.array_compact(F.array(F.when(F.col("same"), "Duplicate"), F.when(F.col("other"), "Related")))
    return pairs.select("file_a", "file_b", F.explode(kinds).alias("relationship"))


_PAIRS = """li AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem),
pairs AS (SELECT DISTINCT a.l_suppkey AS file_a, b.l_suppkey AS file_b, CASE WHEN a.l_returnflag = b.l_returnflag THEN 'Duplicate' ELSE 'Related' END AS relationship FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)"""
PAIR_ROLLUP = f"WITH {_PAIRS} SELECT relationship, (SELECT count(*) FROM pairs q WHERE q.relationship = p.relationship) AS pairs, count(DISTINCT file) AS files FROM (SELECT relationship, unnest([file_a, file_b]) AS file FROM pairs) p GROUP BY relationship"


def files_in_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that stand on either side of a pair."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return rollups.files_in_pairs(s, _pairs(spark, d).where("relationship = 'Duplicate'"), "s_suppkey")


FILES_IN_PAIRS = f"WITH {_PAIRS} SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT file_a FROM pairs WHERE relationship = 'Duplicate' UNION SELECT file_b FROM pairs WHERE relationship = 'Duplicate')"


def rationalisation(spark: SparkSession, d: str) -> DataFrame:
    """Distinct unordered pairs per kind with the first examples."""
    p = _pairs(spark, d).select(F.col("relationship").alias("kind"), "file_a", "file_b")
    both = p.union(p.select("kind", F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b")))
    return rollups.rationalisation(both).select("kind", "items", F.array_join("examples", "; ").alias("examples"))


RATIONALISATION = f"WITH {_PAIRS} SELECT relationship AS kind, count(*) AS items, array_to_string(list(file_a || ' / ' || file_b ORDER BY file_a, file_b)[1:5], '; ') AS examples FROM pairs GROUP BY relationship"


QUERIES = {
    f.__name__: f
    for f in (
        error_rollup, error_groups, error_details, downstream_outputs, hidden_groups, coverage, overview, column_profile, row_profile, occupancy,
        formula_profile, top_functions, complexity, cell_regions, unclaimed_cells, citations, incremental, streamed_changes, remaining_children, selected_files,
        portfolio_findings, assessment_long, pair_rollup, files_in_pairs, rationalisation,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
