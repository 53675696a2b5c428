"""Regions, sheet rules and file rules over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalars import range_ref
from gridloom.operators import detect, graph, regions, rules
from gridloom.plans.base import any_of, table, tasks


def _grid(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """All line items as populated cells in sheets of 50 orders: a row an order, a column or the next a line, by its quantity.

    whole: dealt by sheet, many small sheets a task and tasks of bounded rows, so that steps by sheet and more move nothing again.
    """
    li = table(spark, d, "lineitem")
    column = 2 * F.col("l_linenumber") - (F.col("l_quantity") > 25).cast("int")
    cells = li.select(F.floor(F.col("l_orderkey") / 50).alias("sheet"), F.col("l_orderkey").alias("row"), column.alias("col"))
    return (cells.repartition(tasks(li, 1 << 18), "sheet") if whole else cells).distinct()


_GRID = "cells AS (SELECT DISTINCT l_orderkey // 50 AS sheet, l_orderkey AS r, 2 * l_linenumber - CAST(l_quantity > 25 AS INT) AS c FROM lineitem)"


def row_runs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of populated cells per row."""
    return regions.row_runs(_grid(spark, d), ["sheet"])


ROW_RUNS = f"WITH {_GRID}, g AS (SELECT *, c - row_number() OVER (PARTITION BY sheet, r ORDER BY c) AS k FROM cells) SELECT sheet, r AS row, min(c) AS c1, max(c) AS c2, count(*) AS n FROM g GROUP BY sheet, r, k"


def occupancy_plates(spark: SparkSession, d: str) -> DataFrame:
    """Populated cells as rectangles of one flag; the flag changes by columns and now and then by rows."""
    flag = F.pmod(F.floor(F.col("row") / 7) + F.floor(F.col("col") / 3), F.lit(4)).cast("int") + 1
    return regions.plates(_grid(spark, d, whole=True).withColumn("flag", flag), ["sheet"])


OCCUPANCY_PLATES = f"""
WITH {_GRID}, x AS (SELECT *, CAST((r // 7 + c // 3) % 4 AS INT) + 1 AS flag FROM cells), g AS (SELECT *, c - row_number() OVER (PARTITION BY sheet, r, flag ORDER BY c) AS k FROM x),
runs AS (SELECT sheet, flag, r, min(c) AS c1, max(c) AS c2, count(*) AS n FROM g GROUP BY sheet, flag, r, k), h AS (SELECT *, r - row_number() OVER (PARTITION BY sheet, flag, c1, c2 ORDER BY r) AS k FROM runs)
SELECT sheet, flag, c1, c2, min(r) AS r1, max(r) AS r2, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY sheet, flag, c1, c2, k
"""


def component_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Bounding boxes of cells that hang together."""
    return regions.components(_grid(spark, d), ["sheet"])


COMPONENT_BOXES = f"""
WITH RECURSIVE {_GRID}, g AS (SELECT *, c - row_number() OVER (PARTITION BY sheet, r ORDER BY c) AS k FROM cells),
runs AS (SELECT sheet, r, min(c) AS c1, max(c) AS c2, count(*) AS n, row_number() OVER () AS id FROM g GROUP BY sheet, r, k),
near AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.sheet = b.sheet AND b.r <> a.r AND b.r - a.r BETWEEN -2 AND 2 AND a.c1 <= b.c2 AND b.c1 <= a.c2),
reach AS (SELECT id AS a, id AS b FROM runs UNION SELECT x.a, n.b FROM reach x JOIN near n ON x.b = n.a),
low AS (SELECT b AS id, min(a) AS comp FROM reach GROUP BY b)
SELECT sheet, min(r) AS top, min(c1) AS left, max(r) AS bottom, max(c2) AS right, CAST(sum(n) AS BIGINT) AS n_cells FROM runs JOIN low USING (id) GROUP BY sheet, comp
"""


def region_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Orders as regions with made-up aggregates: kinds, totals rows and confidence."""
    o = table(spark, d, "orders")
    k = lambda n, of="o_orderkey": F.pmod(F.col(of), F.lit(n))
    r = o.select(
        "o_orderkey",
        F.when(k(9) == 0, "listobject").otherwise("detected").alias("origin"),
        F.lit(1).alias("left"), (1 + k(5)).alias("right"), F.lit(1).alias("top"), (1 + k(40, "o_custkey")).alias("bottom"),
        (k(60, "o_custkey") + 1).alias("mean_length"), (k(3)).alias("n_header_rows"), (k(10, "o_custkey") / 10.0).alias("left_text"),
        (k(8, "o_custkey")).alias("formula_cells"), F.lit(10).alias("n_cells"), (k(6)).alias("n_data_rows"),
        F.concat_ws(" ", F.get(F.array(*map(F.lit, (" Grand Total", "Net x", "Totally", "balance", "a sum", "Sub-total"))), k(6).cast("int")), "o_orderpriority").alias("label"),
    )
    conf = regions.adjusted_confidence(F.lit(0.6), F.col("left_text"), F.col("n_header_rows") > 0, F.col("n_data_rows"), F.lit(5.0), F.col("n_data_rows").cast("double"))
    return r.select("o_orderkey", regions.region_kind().alias("kind"), regions.totals_row(F.col("label"), F.col("formula_cells"), F.lit(9)).alias("has_totals"), conf.alias("confidence"))


REGION_KINDS = r"""
WITH x AS (SELECT o_orderkey, o_orderkey % 9 = 0 AS lo, o_orderkey % 5 + 1 AS wide, o_custkey % 40 + 1 AS tall, o_custkey % 60 + 1 AS len, o_orderkey % 3 AS heads, (o_custkey % 10) / 10.0::DOUBLE AS lt, o_custkey % 8 AS f, o_orderkey % 6 AS n FROM orders)
SELECT o_orderkey, CASE WHEN lo THEN 'data_table' WHEN wide <= 2 AND len > 40 THEN 'notes' WHEN wide <= 3 AND tall <= 25 AND heads = 0 AND lt > 0.7 THEN 'key_value' WHEN f / 10.0::DOUBLE > 0.55 THEN 'calculation' WHEN heads > 1 THEN 'matrix' WHEN heads > 0 AND n >= 2 THEN 'data_table' ELSE 'unknown' END AS kind,
 n IN (0, 1, 3, 5) OR f >= 4 AS has_totals,
 round(CASE WHEN heads > 0 AND n >= 3 AND n / 5.0::DOUBLE >= 0.8 THEN least(1.0::DOUBLE, CASE WHEN lt < 0.5 THEN 0.6::DOUBLE * 0.75 ELSE 0.6::DOUBLE END + 0.15::DOUBLE * (n / 5.0::DOUBLE)) ELSE CASE WHEN lt < 0.5 THEN 0.6::DOUBLE * 0.75 ELSE 0.6::DOUBLE END END, 2) AS confidence FROM x
"""


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """The best header row of order sheets, from row profiles."""
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 20).alias("sheet"), F.col("l_orderkey").alias("row"), "l_linenumber", "l_quantity", "l_discount").distinct()
    p = li.groupBy("sheet", "row").agg(F.round(F.avg((F.col("l_quantity") > 25).cast("double")), 3).alias("text_ratio"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 3).alias("styled"), F.round(F.count_distinct("l_linenumber") / F.count("*"), 3).alias("distinct"), F.round(F.count("*") / 10, 3).alias("density"), F.lit(0.25).alias("formula_ratio"))
    p = p.withColumn("top", F.col("sheet") * 20).withColumn("body_text", F.lit(0.3)).withColumn("body_style", F.lit(0.2))
    return regions.header_rows(p, ["sheet"])


HEADER_ROWS = """
WITH li AS (SELECT DISTINCT l_orderkey // 20 AS sheet, l_orderkey AS r, l_linenumber, l_quantity, l_discount FROM lineitem),
p AS (SELECT sheet, r, round(avg(CAST(l_quantity > 25 AS DOUBLE)), 3) AS t, round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 3) AS s, round(CAST(count(DISTINCT l_linenumber) AS DOUBLE) / count(*), 3) AS u, round(count(*) / 10.0::DOUBLE, 3) AS n FROM li GROUP BY sheet, r),
q AS (SELECT sheet, r, (0.40::DOUBLE * greatest(0.0::DOUBLE, t - 0.3) + 0.25::DOUBLE * greatest(0.0::DOUBLE, s - 0.2) + 0.20::DOUBLE * u + 0.15::DOUBLE * n) * 0.8::DOUBLE AS score FROM p WHERE r - sheet * 20 BETWEEN 0 AND 3)
SELECT sheet, CASE WHEN max(score) >= 0.15 THEN -max(struct_pack(s := score, up := -r)).up END AS header_row, round(max(score), 6) AS score FROM q GROUP BY sheet
"""


def merged_headers(spark: SparkSession, d: str) -> DataFrame:
    """Labels of customers' order sheets: an order a column, under bands of four, under which lie bands of two but for every third customer."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file_pk"), F.expr("cast(o_orderkey div 50000 as int)").alias("position"), "o_custkey", "o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("string").alias("year"), "o_orderpriority")
    sheet = Window.partitionBy("file_pk", "position")
    o = o.withColumn("col", F.row_number().over(sheet.orderBy("o_orderkey"))).withColumn("n", F.count("*").over(sheet).cast("int")).withColumn("region_id", F.lit(1))
    two = F.col("o_custkey") % 3 != 0
    cell = F.array(F.struct(F.lit(1).alias("row"), F.when(F.col("col") % 4 == 1, F.col("o_orderstatus")).alias("text")), F.struct(F.lit(2).alias("row"), F.when(F.col("col") % 2 == 1, F.col("year")).alias("text")), F.struct(F.lit(3).alias("row"), F.col("o_orderpriority").alias("text")))
    cells = o.select("file_pk", "position", "region_id", "col", F.explode(cell).alias("c")).select("file_pk", "position", "region_id", "col", "c.*").where("text is not null")
    merge = lambda row, size: F.when((F.col("col") % size == 1) & (F.col("col") < F.col("n")), range_ref(F.lit(row), F.col("col"), F.lit(row), F.least("n", F.col("col") + size - 1)))
    merges = F.flatten(F.collect_list(F.array_compact(F.array(merge(1, 4), F.when(two, merge(2, 2))))))
    sheets = o.groupBy("file_pk", "position").agg(merges.alias("merges"))
    part = lambda size: F.ceil(F.col("n") / size).cast("long")
    found = o.where("col = 1").select("file_pk", "position", "region_id", F.lit(1).alias("left"), F.col("n").alias("right"), F.lit(9).alias("bottom"), F.lit(1).alias("header_row"), F.create_map(F.lit(1), part(4), F.lit(2), part(2), F.lit(3), F.col("n").cast("long")).alias("filled"))
    out = detect.merged_headers(found, detect.bands(sheets), cells)
    return out.select("file_pk", "position", "label_row", F.array_join("labels", "|").alias("labels"), "blanks")


MERGED_HEADERS = """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS file_pk, CAST(o_orderkey // 50000 AS INT) AS position, o_custkey % 3 <> 0 AS two, o_orderstatus AS s, CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderpriority AS p,
 row_number() OVER (PARTITION BY o_custkey, o_orderkey // 50000 ORDER BY o_orderkey) AS c, count(*) OVER (PARTITION BY o_custkey, o_orderkey // 50000) AS n FROM orders),
b AS (SELECT *, first_value(s) OVER (PARTITION BY file_pk, position, (c - 1) // 4 ORDER BY c) AS four, first_value(y) OVER (PARTITION BY file_pk, position, (c - 1) // 2 ORDER BY c) AS pair FROM o),
l AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN two THEN 3 ELSE 2 END AS place, CASE WHEN n = 1 THEN s WHEN two THEN p WHEN c % 2 = 1 THEN y ELSE '' END AS own, (c - 1) // 4 * 4 + 1 < n AS in_four, (c - 1) // 2 * 2 + 1 < n AS in_pair FROM b)
SELECT file_pk, position, CAST(max(place) AS INT) AS label_row, string_agg(CASE WHEN own = '' THEN '' ELSE CASE WHEN place > 1 AND in_four THEN four || '::' ELSE '' END || CASE WHEN place > 2 AND in_pair THEN pair || '::' ELSE '' END || own END, '|' ORDER BY c) AS labels,
 CAST(count(*) FILTER (own = '') AS INT) AS blanks FROM l GROUP BY file_pk, position
"""


_LEADS = ("MI pack", "raw data", "calc engine", "lob map", "recon check", "QA signoff", "misc", "Summary model")


def _name() -> Column:
    return F.concat(F.get(F.array(*map(F.lit, _LEADS)), F.pmod("s_suppkey", F.lit(8)).cast("int")), F.lit(" "), F.col("s_suppkey").cast("string"))


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sheets of nations: numbers from keys, edges to the next suppliers of the same nation."""
    s = table(spark, d, "supplier")
    k = lambda n: F.pmod("s_suppkey", F.lit(n))
    edges = _edges(spark, d)
    names = s.select(F.col("s_nationkey").alias("file"), _name().alias("name"))
    dep = graph.degrees(graph.sheet_edges(edges, names), names)
    return s.select(
        F.col("s_nationkey").alias("file"), _name().alias("name"), (k(90) * 3).alias("populated"), k(40).alias("formulas"), k(13).alias("lookup"), k(17).alias("conditional"), k(11).alias("aggregate"), k(3).alias("n_errors"),
        (k(10) == 0).alias("has_pivots"), k(5).alias("external_count"), k(7).alias("literals"), k(2).alias("volatile"), k(6).alias("distinct_skeletons"),
        F.when(k(4) == 0, F.array(F.lit("calculation"), F.lit("title"))).when(k(4) == 1, F.array(F.lit("notes"))).otherwise(F.array(F.lit("data_table"))).alias("kinds"),
        F.array(F.get(F.array(*map(F.lit, ("Source GL", "Opening", "Amount", "FX rate", "Manual adj"))), k(5).cast("int")), F.lit("Target ledger"), F.get(F.array(*map(F.lit, ("Variance", "Policy id", "Note"))), k(3).cast("int"))).alias("headers"),
    ).join(dep, ["file", "name"])


#: Parts of a nation's sheets that read others, each met with all of them.
SHARES = 16


def _edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", _name().alias("name"), (F.pmod("s_suppkey", F.lit(5)) == 0).alias("none"))
    # sums of keys that 3 divides meet by remainders; a nation is dealt by its readers' keys, to as many as SHARES tasks a remainder,
    # and the readers to all tasks where the other side is sent to each
    left = F.pmod("s_suppkey", F.lit(3))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = s.where(~F.col("none")).repartition(tasks, "s_suppkey").withColumn("left", left).withColumn("share", F.pmod(F.xxhash64("s_suppkey"), F.lit(SHARES))).alias("a")
    b = s.withColumn("left", F.pmod(3 - left, F.lit(3))).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))).alias("b")
    met = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.left") == F.col("b.left")) & (F.col("a.share") == F.col("b.share")))
    real = met.select(F.col("a.s_nationkey").alias("file"), F.col("a.name").alias("src"), F.col("b.name").alias("dst"), F.lit(1).alias("n"))
    return real.union(s.select("s_nationkey", "name", F.lit("No such sheet"), F.lit(2)))


_K = """s AS (SELECT s_nationkey AS file, s_suppkey AS id, ['MI pack', 'raw data', 'calc engine', 'lob map', 'recon check', 'QA signoff', 'misc', 'Summary model'][CAST(s_suppkey % 8 + 1 AS INT)] || ' ' || s_suppkey AS name, s_suppkey % 90 * 3 AS populated, s_suppkey % 40 AS formulas, s_suppkey % 13 AS lookup,
 s_suppkey % 17 AS conditional, s_suppkey % 11 AS aggregate, s_suppkey % 3 AS n_errors, s_suppkey % 10 = 0 AS has_pivots, s_suppkey % 5 AS external_count, s_suppkey % 7 AS literals, s_suppkey % 2 AS volatile, s_suppkey % 6 AS shapes FROM supplier),
e AS (SELECT a.file, a.name AS src, b.name AS dst FROM s a JOIN s b ON a.file = b.file AND a.id % 5 <> 0 AND (a.id + b.id) % 3 = 0 AND a.name <> b.name),
t AS (SELECT s.*, EXISTS (SELECT 1 FROM e WHERE e.file = s.file AND e.src = s.name) AS up, EXISTS (SELECT 1 FROM e WHERE e.file = s.file AND e.dst = s.name) AS down, formulas / greatest(1, populated)::DOUBLE AS ratio, lower(name) AS low FROM s)"""


def sheet_edges(spark: SparkSession, d: str) -> DataFrame:
    """Dependency edges between sheets that exist."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), _name().alias("name"))
    return graph.sheet_edges(_edges(spark, d), s)


SHEET_EDGES = f"WITH {_K} SELECT file, src, dst, CAST(1 AS BIGINT) AS n FROM e"


def sheet_degrees(spark: SparkSession, d: str) -> DataFrame:
    """What each sheet reads and is read by."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), _name().alias("name"))
    return graph.degrees(graph.sheet_edges(_edges(spark, d), s), s).select("file", "name", F.array_join("reads", ",").alias("reads"), F.array_join("read_by", ",").alias("read_by"))


SHEET_DEGREES = f"""
WITH {_K} SELECT file, name, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE e.file = s.file AND e.src = s.name), '') AS reads, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE e.file = s.file AND e.dst = s.name), '') AS read_by FROM s
"""


def sheet_rules(spark: SparkSession, d: str) -> DataFrame:
    """Category, confidence, roles, information and area type of every sheet."""
    out = rules.assessed_sheets(_sheets(spark, d))
    return out.select("file", "name", "category", "confidence", F.array_join("roles", ",").alias("roles"), "information", "area_type")


_H = rules.HINTS
_RULED = f"""{_K},
p AS (SELECT *, [
 CASE WHEN {any_of("low", _H["Output"])} THEN 2.0 ELSE 0 END + CASE WHEN formulas > 0 AND NOT down THEN 1.0 ELSE 0 END + CASE WHEN has_pivots THEN 0.5 ELSE 0 END,
 CASE WHEN {any_of("low", _H["Input"])} THEN 2.0 ELSE 0 END + CASE WHEN ratio < 0.1 AND populated > 10 THEN 1.5 + CASE WHEN down THEN 1.0 ELSE 0 END ELSE 0 END,
 CASE WHEN {any_of("low", _H["Calculation"])} THEN 2.0 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 2.0 ELSE 0 END + CASE WHEN ratio > 0.4 THEN 1.5 ELSE 0 END,
 CASE WHEN {any_of("low", _H["Mapping"])} THEN 2.0 ELSE 0 END + CASE WHEN formulas > 0 AND lookup >= formulas * 0.3 THEN 1.5 ELSE 0 END,
 CASE WHEN {any_of("low", _H["Control Check"])} THEN 2.5 ELSE 0 END + CASE WHEN formulas > 0 AND conditional >= formulas * 0.4 THEN 1.0 ELSE 0 END + CASE WHEN n_errors > 0 THEN 0.5 ELSE 0 END,
 CASE WHEN {any_of("low", _H["Validation"])} THEN 2.5 ELSE 0 END]::DOUBLE[] AS sc FROM t),
q AS (SELECT *, list_max(sc) AS top, list_sum(sc) AS total, {list(rules.CATEGORIES)} AS cats FROM p),
c AS (SELECT *, CASE WHEN total > 0 THEN 0.4 + 0.5 * top / total ELSE 0.3 END AS conf, cats[list_position(sc, top)] AS best FROM q),
r AS (SELECT *, CASE WHEN conf < 0.55 THEN 'Uncertain' ELSE best END AS category FROM c),
u AS (SELECT *, list_filter(cats, lambda x, i: sc[i] > 0 AND sc[i] >= 0.5 * top) || CASE WHEN category = 'Calculation' AND NOT down AND formulas > 0 THEN ['Output'] ELSE [] END AS near FROM r),
v AS (SELECT *, CASE WHEN category <> 'Uncertain' THEN [category] || list_filter(near, lambda x, i: x <> category AND list_position(near, x) = i) ELSE list_filter(near, lambda x, i: list_position(near, x) = i) END AS roles FROM u),
w AS (SELECT *, CASE WHEN list_contains(roles, 'Mapping') THEN 'mapping' WHEN list_contains(roles, 'Control Check') OR list_contains(roles, 'Validation') THEN 'control/check' WHEN list_contains(roles, 'Output') THEN 'final output'
 WHEN populated > 0 AND ratio < 0.1 THEN CASE WHEN down THEN 'data input' ELSE 'supporting schedule' END WHEN down AND (up OR ratio > 0.2) THEN 'intermediate working' WHEN ratio > 0.1 AND NOT down THEN 'final output' WHEN id % 4 = 1 THEN 'supporting schedule' ELSE 'intermediate working' END AS information FROM v),
z AS (SELECT *, list_distinct(roles || [category]) AS every FROM w)"""
SHEET_RULES = f"""
WITH {_RULED} SELECT file, name, category, round(conf, 4) AS confidence, array_to_string(roles, ',') AS roles, information,
 CASE WHEN list_contains(every, 'Output') THEN 'final output' WHEN list_contains(every, 'Control Check') OR list_contains(every, 'Validation') THEN 'control / check' WHEN list_contains(every, 'Mapping') THEN 'mapping / lookup table' WHEN list_contains(every, 'Input') THEN 'input' WHEN list_contains(every, 'Calculation') THEN 'calculation / working area' WHEN information = 'supporting schedule' THEN 'supporting schedule' ELSE 'unknown' END AS area_type FROM z
"""


def validation_flags(spark: SparkSession, d: str) -> DataFrame:
    """Reasons for a review of each sheet, in order."""
    out = rules.assessed_sheets(_sheets(spark, d))
    found = rules.reconciliation(F.col("name"), F.col("headers"))
    out = out.withColumn("reconciliations", F.array_compact(F.array(found)))
    triggers = rules.validation_triggers()
    return out.select("file", "name", F.when(F.size(triggers) > 0, "Y").otherwise("N").alias("required"), F.array_join(triggers, "; ").alias("reasons"))


_HEADS = "['Source GL', 'Opening', 'Amount', 'FX rate', 'Manual adj'][CAST(id % 5 + 1 AS INT)]"
_FOUND = f"""({any_of(f"lower({_HEADS})", rules.SOURCE_HINTS)} AND (id % 3 = 0 OR {any_of("low", rules.COMPARISON_HINTS)}))"""
VALIDATION_FLAGS = f"""
WITH {_RULED}, f AS (SELECT *, list_filter([CASE WHEN n_errors > 0 THEN 'cached errors' END, CASE WHEN external_count > 0 THEN 'external references' END, CASE WHEN literals > 3 THEN 'hardcoded values' END, CASE WHEN volatile > 0 THEN 'volatile functions' END,
 CASE WHEN {_FOUND} THEN 'reconciliation to confirm' END, CASE WHEN category = 'Uncertain' THEN 'uncertain category' END, CASE WHEN formulas = 0 AND populated > 20 AND ({any_of("low", rules.MANUAL)} OR id % 5 = 4) THEN 'manual entry label' END], lambda x: x IS NOT NULL) AS reasons FROM z)
SELECT file, name, CASE WHEN len(reasons) > 0 THEN 'Y' ELSE 'N' END AS required, array_to_string(reasons, '; ') AS reasons FROM f
"""


def reconciliations(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose headers compare two sources: the columns, key and cues."""
    s = _sheets(spark, d)
    found = s.select("file", "name", rules.reconciliation(F.col("name"), F.col("headers")).alias("x")).where("x is not null")
    return found.select("file", "name", "x.source_a", "x.source_b", "x.matching_criteria", F.array_join("x.cues", ",").alias("cues"))


RECONCILIATIONS = f"""
WITH {_K}, h AS (SELECT *, {_HEADS} AS h1, ['Variance', 'Policy id', 'Note'][CAST(id % 3 + 1 AS INT)] AS h3 FROM t)
SELECT file, name, CASE WHEN {any_of("lower(h1)", rules.SOURCE_HINTS)} THEN h1 ELSE 'Target ledger' END AS source_a, 'Target ledger' AS source_b, CASE WHEN id % 3 = 1 THEN 'Policy id' ELSE 'no key column' END AS matching_criteria, CASE WHEN id % 3 = 0 THEN 'Variance' ELSE '' END AS cues
FROM h WHERE {any_of("lower(h1)", rules.SOURCE_HINTS)} AND (id % 3 = 0 OR {any_of("low", rules.COMPARISON_HINTS)})
"""


def manual_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Labels that speak of manual entry."""
    return _sheets(spark, d).select("file", "name", F.array_join(rules.manual_evidence(F.col("name"), F.col("headers")), ",").alias("labels"))


MANUAL_EVIDENCE = f"WITH {_K} SELECT file, name, CASE WHEN id % 5 = 4 THEN 'manual adj' ELSE '' END AS labels FROM t"


def calculation_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """What each sheet calculates, where its structure tells."""
    out = rules.assessed_sheets(_sheets(spark, d))
    return out.select("file", "name", rules.calculation_description(out).alias("description"))


_WHAT = {k: f"'{v}'" for k, v in rules.DESCRIPTIONS.items()}
CALCULATION_DESCRIPTIONS = f"""
WITH {_RULED} SELECT file, name, CASE WHEN formulas = 0 THEN NULL WHEN id % 5 = 1 THEN {_WHAT["roll-forward"]} WHEN id % 5 = 3 THEN {_WHAT["exchange"]}
 WHEN list_contains(roles, 'Mapping') OR lookup >= formulas * 0.3 THEN {_WHAT["mapping"]} WHEN list_contains(roles, 'Control Check') OR list_contains(roles, 'Validation') THEN {_WHAT["control"]}
 WHEN list_contains(roles, 'Output') THEN {_WHAT["output"]} WHEN aggregate >= formulas * 0.3 THEN {_WHAT["aggregate"]} END AS description FROM z
"""


def upstream_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sheets that each sheet reads, mapping tables apart."""
    s = rules.assessed_sheets(_sheets(spark, d))
    names = s.select("file", "name")
    out = rules.upstream(graph.sheet_edges(_edges(spark, d), names), s)
    return out.select("file", "name", F.array_join("sheets", ",").alias("sheets"), F.array_join("mapping_tables", ",").alias("mapping_tables"))


UPSTREAM_GROUPS = f"""
WITH {_RULED} SELECT e.file, e.src AS name, coalesce(string_agg(e.dst, ',' ORDER BY e.dst) FILTER (NOT list_contains(z.roles, 'Mapping')), '') AS sheets, coalesce(string_agg(e.dst, ',' ORDER BY e.dst) FILTER (list_contains(z.roles, 'Mapping')), '') AS mapping_tables
FROM e JOIN z ON z.file = e.file AND z.name = e.dst GROUP BY e.file, e.src
"""


def downstream_roles(spark: SparkSession, d: str) -> DataFrame:
    """Readers of each sheet with their roles."""
    s = rules.assessed_sheets(_sheets(spark, d))
    out = rules.downstream(graph.sheet_edges(_edges(spark, d), s.select("file", "name")), s)
    return out.select("file", "name", F.array_join(F.transform("consumers", lambda x: F.concat_ws("=", x["sheet"], x["role"])), ",").alias("consumers"))


DOWNSTREAM_ROLES = f"""
WITH {_RULED}, o AS (SELECT file, name, CASE WHEN list_contains(every, 'Output') THEN 'final output' WHEN list_contains(every, 'Control Check') OR list_contains(every, 'Validation') THEN 'control / check' WHEN information = 'supporting schedule' THEN 'supporting schedule' ELSE 'intermediate working' END AS role FROM z)
SELECT e.file, e.dst AS name, string_agg(e.src || '=' || o.role, ',' ORDER BY e.src) AS consumers FROM e JOIN o ON o.file = e.file AND o.name = e.src GROUP BY e.file, e.dst
"""


def simplification(spark: SparkSession, d: str) -> DataFrame:
    """Structural issues per sheet, what could change and what for."""
    return rules.simplification(rules.assessed_sheets(_sheets(spark, d)).withColumn("formulas", F.col("formulas") * 4))


SIMPLIFICATION = f"""
WITH {_RULED} SELECT file, name, information, 'hardcoded numbers' AS issue, CAST(literals AS BIGINT) AS amount, 'keep constants in cells of their own' AS proposed_change, 'they can be seen and checked' AS expected_benefit, true AS confirm FROM z WHERE literals > 5
UNION ALL SELECT file, name, information, 'volatile functions', volatile, 'use fixed references', 'less is recalculated', true FROM z WHERE volatile > 0
UNION ALL SELECT file, name, information, 'little reuse of shapes', shapes, 'use one formula for each column', 'fewer formulas to review', true FROM z WHERE formulas * 4 > 50 AND shapes > 0 AND formulas * 4 / shapes::DOUBLE < 3
"""


def automation(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose labels speak of a manual step, with the signals."""
    return rules.automation(_sheets(spark, d)).select("file", "name", "repeated_pattern", F.array_join("signals", "; ").alias("signals"), "confirm")


AUTOMATION = f"""
WITH {_K}, r AS (SELECT *, coalesce(formulas / nullif(shapes, 0)::DOUBLE, 0) AS reuse FROM t)
SELECT file, name, reuse >= 5 AS repeated_pattern, 'labels speak of manual work' || CASE WHEN reuse >= 5 THEN '; uses per shape: ' || CAST(round(reuse, 1) AS VARCHAR) ELSE '' END AS signals, true AS confirm FROM r WHERE {any_of('low', rules.WORKFLOW)} OR id % 5 = 4
"""


def deliverables(spark: SparkSession, d: str) -> DataFrame:
    """Outputs by role that are reports by name."""
    return rules.deliverables(rules.assessed_sheets(_sheets(spark, d)))


DELIVERABLES = f"WITH {_RULED} SELECT file, name FROM z WHERE list_contains(every, 'Output') AND {any_of('low', rules.DELIVERABLES)}"


def logic_types(spark: SparkSession, d: str) -> DataFrame:
    """Activities of each nation's workbook, primary and all, and its business area."""
    s = rules.assessed_sheets(_sheets(spark, d))
    f = s.groupBy("file").agg(F.sum("lookup").alias("lookup"), F.sum("aggregate").alias("aggregate"), F.sum("conditional").alias("textual"), F.sum("formulas").alias("formulas"), F.count_if("has_pivots").alias("n_pivots"), F.array_distinct(F.flatten(F.collect_set(F.array_union("roles", F.array("category"))))).alias("sheet_roles"))
    f = f.withColumn("has_power_query", F.pmod("file", F.lit(4)) == 0)
    out = rules.logic_types(f)
    return out.select("file", "logic_type", "logic_confidence", F.array_join("logic_types", ",").alias("logic_types"), "business_area")


LOGIC_TYPES = f"""
WITH {_RULED}, f AS (SELECT file, sum(lookup) + sum(conditional) + CASE WHEN file % 4 = 0 THEN 5 ELSE 0 END AS dt, sum(lookup) AS lk, sum(aggregate) AS ag, sum(formulas) AS fm, CASE WHEN count(*) FILTER (has_pivots) > 0 THEN 3 ELSE 0 END AS rp, list_distinct(flatten(list(every))) AS rs FROM z GROUP BY file),
g AS (SELECT *, CASE WHEN fm > 0 AND ag + dt + rp = 0 THEN 1 ELSE ag END AS ca FROM f),
h AS (SELECT *, list_reverse_sort(list_filter([{{'s': dt, 'k': CASE WHEN lk > 0 THEN 0 ELSE -2 END, 't': 'Data Transformation'}}, {{'s': ca, 'k': -1, 't': 'Calculation'}}, {{'s': rp, 'k': -3, 't': 'Reporting'}}], lambda x: x.s > 0)) AS rk FROM g),
i AS (SELECT *, list_transform(list_filter(rk, lambda x: x.s >= 0.25 * rk[1].s), lambda x: x.t) || CASE WHEN list_contains(rs, 'Mapping') THEN ['Data Transformation'] ELSE [] END || CASE WHEN list_contains(rs, 'Output') THEN ['Reporting'] ELSE [] END || CASE WHEN list_contains(rs, 'Control Check') OR list_contains(rs, 'Validation') THEN ['Reconciliation / Control'] ELSE [] END || CASE WHEN list_contains(rs, 'Input') THEN ['Manual Input'] ELSE [] END AS tt FROM h),
j AS (SELECT *, CASE WHEN len(tt) = 0 THEN ['Other'] ELSE list_filter(tt, lambda x, i: list_position(tt, x) = i) END AS ty FROM i)
SELECT file, coalesce(rk[1].t, 'Other') AS logic_type, CASE WHEN len(rk) = 0 THEN 0.4 ELSE round(least(0.9, 0.5 + 0.4 * rk[1].s / list_sum(list_transform(rk, lambda x: x.s))), 4) END AS logic_confidence, array_to_string(ty, ',') AS logic_types,
 array_to_string(list_transform(ty, lambda x: CASE x WHEN 'Calculation' THEN 'Calculation / modelling' WHEN 'Reconciliation / Control' THEN 'Reconciliation / control' WHEN 'Data Transformation' THEN 'Data preparation / transformation' WHEN 'Reporting' THEN 'Reporting / MI' WHEN 'Manual Input' THEN 'Manual data capture' ELSE 'General-purpose / other' END), '; ') AS business_area FROM j
"""


def key_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents' languages by case-folded name, with references and purpose."""
    t = table(spark, d, "documents")
    name = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.upper("source")).otherwise(F.col("source"))
    rows = t.select(F.col("lang").alias("file"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "External workbook").otherwise("Formal data connection").alias("source_type"), F.concat(name, F.lit(" rates")).alias("source_name"), F.lit(1).alias("n"), F.col("doc_id").alias("position"))
    return rules.key_inputs(rows)


KEY_INPUTS = """
WITH x AS (SELECT lang AS file, CASE WHEN doc_id % 3 = 0 THEN 'External workbook' ELSE 'Formal data connection' END AS source_type, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || ' rates' AS n, doc_id FROM documents)
SELECT file, source_type, arg_min(n, doc_id) AS source_name, count(*) AS reference_count, 'Exchange rates' AS business_purpose FROM x GROUP BY file, source_type, lower(n)
"""


def visible_first(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation, hidden ones last; and the note on a small population."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("position"), F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "hidden").otherwise("visible").alias("state"))
    return rules.visible_first(s).select("file", "position", "place", rules.corpus_note(F.pmod("position", F.lit(7))).alias("note"))


VISIBLE_FIRST = """
SELECT s_nationkey AS file, s_suppkey AS position, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_suppkey % 3 = 0 AS INT), s_suppkey) AS place,
 CASE WHEN s_suppkey % 7 = 0 THEN 'no other file to compare with' WHEN s_suppkey % 7 < 5 THEN 'compared with ' || s_suppkey % 7 || ' other file(s) only' END AS note FROM supplier
"""

QUERIES = {
    f.__name__: f
    for f in (
        row_runs, occupancy_plates, component_boxes, region_kinds, header_rows, merged_headers, sheet_edges, sheet_degrees, sheet_rules, validation_flags, reconciliations, manual_evidence,
        calculation_descriptions, upstream_groups, downstream_roles, simplification, automation, deliverables, logic_types, key_inputs, visible_first,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
