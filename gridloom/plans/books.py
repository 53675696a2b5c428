"""The reader, the detector and the assessment over workbooks made from the test tables: all customers, dealt by nation and key.

A workbook holds the customers of a nation within one range of keys, so its size is bounded however many customers there are.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans import portfolio
from gridloom.plans.base import table, tasks
from gridloom.sinks.xlsx import HEADER, Cell, Sheet, write
from gridloom.sources import workbook


#: Customer keys to a workbook.
RANGE = 50_000


def _book(rows: pd.DataFrame) -> pd.DataFrame:
    """A nation's workbook: its customers with twice their balance (an error where it is negative), and a sum on a sheet of its own."""
    rows = rows.sort_values("c_custkey")
    nation = rows.iloc[0]
    key = int(nation["n_nationkey"])
    data: list[list] = [[Cell(h, HEADER) for h in ("Key", "Name", "Balance", "Twice")]]
    for r, x in enumerate(rows.itertuples(index=False), 2):
        twice = Cell("#DIV/0!", formula=f"C{r}/0") if x.c_acctbal < 0 else Cell(2.0 * x.c_acctbal, formula=f"C{r}*2")
        data.append([int(x.c_custkey), x.c_name, float(x.c_acctbal), twice])
    total = Cell(float(len(rows)), formula=f"COUNT('Customer data'!A2:A{len(data)})")
    sheets = [Sheet("Customer data", data), Sheet("Summary report", [["Item", "Amount"], ["Customers", total]], state="hidden" if key % 5 == 0 else "visible")]
    out = io.BytesIO()
    links = (f"file:///C:/books/{nation['r_name']}%20rates.xlsx",) if key % 4 == 0 else ()
    write(out, sheets, creator=nation["r_name"], links=links, vba=key % 6 == 0)
    content = out.getvalue()
    return pd.DataFrame([[f"/books/{nation['part']}-{nation['n_name']}.xlsx", len(content), content]], columns=["path", "length", "content"])


def _dealt(spark: SparkSession, d: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A file of every nation and range of customer keys."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    every = table(spark, d, "customer")
    customer = every.select("c_nationkey", "c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.expr(f"c_custkey div {RANGE}").alias("part"))
    # with a number given, small parts are not joined up: writing and reading a file takes far longer than its rows' bytes tell
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).repartition(tasks(every, 1 << 14), "n_nationkey", "part")
    return workbook.hashed(rows.groupBy("n_nationkey", "part").applyInPandas(make, "path string, length long, content binary"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _book)


def _read(spark: SparkSession, d: str) -> DataFrame:
    with workbook.small_batches(spark):
        return portfolio.spool(workbook.read(_files(spark, d)))


_C = f"""c AS (SELECT c_custkey // {RANGE} || '-' || n_name || '.xlsx' AS file_name, n_nationkey AS k, r_name, c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS b, row_number() OVER (PARTITION BY n_nationkey, c_custkey // {RANGE} ORDER BY c_custkey) + 1 AS r
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), f AS (SELECT file_name, k, r_name, count(*) AS n, count(*) FILTER (b < 0) AS bad FROM c GROUP BY ALL)"""


def workbook_files(spark: SparkSession, d: str) -> DataFrame:
    """What the packages say of each file: properties, links, macros, sheets and their states."""
    b = workbook.books(_read(spark, d))
    return b.select("file_name", "parse_status", "creator", "has_vba", F.array_join("external_links", ";").alias("links"), F.array_join(F.transform("sheets", lambda s: F.concat(s["name"], F.lit(":"), s["state"])), ";").alias("sheets"), F.length("sha256").alias("hash_length"))


WORKBOOK_FILES = f"""
WITH {_C} SELECT file_name, 'full' AS parse_status, r_name AS creator, k % 6 = 0 AS has_vba, CASE WHEN k % 4 = 0 THEN 'file:///C:/books/' || r_name || '%20rates.xlsx' ELSE '' END AS links,
 'Customer data:visible;Summary report:' || CASE WHEN k % 5 = 0 THEN 'hidden' ELSE 'visible' END AS sheets, 64 AS hash_length FROM f
"""


def workbook_cells(spark: SparkSession, d: str) -> DataFrame:
    """All cells as the reader gives them."""
    found = _read(spark, d)
    # written down: among the cells Spark guesses names to be as large as these, and may send all cells to every task
    names = portfolio.spool(workbook.books(found).select("file_pk", "file_name"))
    return workbook.cells(found).join(names, "file_pk").select("file_name", "sheet", "row", "col", "text", F.expr("try_cast(value AS DOUBLE)").alias("number"), "formula", "is_text", "is_number", "is_error", "bold", "filled")


WORKBOOK_CELLS = f"""
WITH {_C}, cell AS (
 SELECT file_name, 'Customer data' AS sheet, 1 AS "row", unnest([1, 2, 3, 4]) AS col, unnest(['Key', 'Name', 'Balance', 'Twice']) AS text, NULL::DOUBLE AS number, NULL::VARCHAR AS formula, true AS is_text, false AS is_number, false AS is_error, true AS bold FROM f
 UNION ALL SELECT file_name, 'Customer data', r, 1, '', c_custkey, NULL, false, true, false, false FROM c UNION ALL SELECT file_name, 'Customer data', r, 2, c_name, NULL, NULL, true, false, false, false FROM c
 UNION ALL SELECT file_name, 'Customer data', r, 3, '', b, NULL, false, true, false, false FROM c
 UNION ALL SELECT file_name, 'Customer data', r, 4, CASE WHEN b < 0 THEN '#DIV/0!' ELSE '' END, CASE WHEN b >= 0 THEN 2 * b END, CASE WHEN b < 0 THEN '=C' || r || '/0' ELSE '=C' || r || '*2' END, b < 0, b >= 0, b < 0, false FROM c
 UNION ALL SELECT file_name, 'Summary report', unnest([1, 1, 2]), unnest([1, 2, 1]), unnest(['Item', 'Amount', 'Customers']), NULL, NULL, true, false, false, false FROM f
 UNION ALL SELECT file_name, 'Summary report', 2, 2, '', n, '=COUNT(''Customer data''!A2:A' || (n + 1) || ')', false, true, false, false FROM f)
SELECT file_name, sheet, CAST("row" AS INT) AS "row", col, text, number, formula, is_text, is_number, is_error, bold, bold AS filled FROM cell
"""


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return portfolio.tables_of(_files(spark, d))


def workbook_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions that the detector finds, with headers and column types."""
    t = _tables(spark, d)
    names = t["sheet"].select("file_pk", "position", "name").join(t["workbook"].select("file_pk", "file_name"), "file_pk")
    out = t["region"].join(names, ["file_pk", "position"])
    return out.select("file_name", F.col("name").alias("sheet"), "ref", "kind", F.array_join("headers", ",").alias("headers"), F.col("n_data_rows").cast("long").alias("n_data_rows"), F.array_join(F.transform("columns", lambda c: c["inferred_type"]), ",").alias("types"))


WORKBOOK_REGIONS = f"""
WITH {_C} SELECT file_name, 'Customer data' AS sheet, 'A1:D' || (n + 1) AS ref, 'data_table' AS kind, 'Key,Name,Balance,Twice' AS headers, CAST(n AS BIGINT) AS n_data_rows,
 'number,text,number,' || CASE WHEN n - bad > n * 0.6 THEN 'number' WHEN bad > n * 0.6 THEN 'text' ELSE 'mixed' END AS types FROM f
UNION ALL SELECT file_name, 'Summary report', 'A1:B2', 'key_value', '', 2, 'text,mixed' FROM f
"""


def workbook_errors(spark: SparkSession, d: str) -> DataFrame:
    """Cached errors by file, sheet and region, with the first cells."""
    t = _tables(spark, d)
    groups = portfolio.error_groups(t, portfolio.sheet_facts(t)).join(t["workbook"].select("file_pk", "file_name"), "file_pk")
    return groups.select("file_name", "sheet", "error", "region", "count", F.array_join("sample_cells", ",").alias("cells"), F.array_join("downstream_outputs", ",").alias("downstream"), "recalc_required")


WORKBOOK_ERRORS = f"""
WITH {_C} SELECT file_name, 'Customer data' AS sheet, '#DIV/0!' AS error, 'A1:D' || (n + 1) AS region, bad AS count,
 (SELECT array_to_string(list('D' || r ORDER BY r)[1:25], ',') FROM c WHERE c.file_name = f.file_name AND b < 0) AS cells, 'Summary report' AS downstream, true AS recalc_required FROM f WHERE bad > 0
"""


def workbook_resume(spark: SparkSession, d: str) -> DataFrame:
    """Files that a resumed run reads again: new, changed, or failed before; told by hashes."""
    files = portfolio.spool(_files(spark, d))
    place = F.ascii(F.substring("path", -6, 1))
    before = files.select("path", F.col("length").alias("size_bytes"), F.when(place % 3 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("sha256"), F.when(place % 3 == 1, "failed").otherwise("full").alias("parse_status"))
    return portfolio.unseen(files, before).select(F.regexp_extract("path", "[^/]*$", 0).alias("file_name"))


WORKBOOK_RESUME = f"WITH {_C} SELECT file_name FROM f WHERE ascii(substr(file_name, length(file_name) - 5, 1)) % 3 <> 2"

_ABOUT_FILES = ("complexity", "preparer", "usage_frequency", "potential_retirement", "macros", "external_links", "reconciliation")
_ABOUT_TABS = ("visibility", "category", "upstream", "downstream", "calculation")


def workbook_fields(spark: SparkSession, d: str) -> DataFrame:
    """Assessment fields of files and sheets, with their basis, from a whole assessment."""
    t = portfolio.assess(_tables(spark, d))
    files = t["file_field"].where(F.col("field").isin(list(_ABOUT_FILES))).select("file_name", F.lit("").alias("sheet"), "field", "value", "basis")
    tabs = t["tab_field"].where(F.col("field").isin(list(_ABOUT_TABS))).join(t["workbook"].select("file_pk", "file_name"), "file_pk").select("file_name", F.col("name").alias("sheet"), "field", "value", "basis")
    return files.unionByName(tabs)


WORKBOOK_FIELDS = f"""
WITH {_C}, p AS (SELECT *, CAST(4 * n + 8 > 2000 AS INT) + CAST(4 * n + 8 > 20000 AS INT) + CASE WHEN n + 1 > 5000 THEN 2 WHEN n + 1 > 200 THEN 1 ELSE 0 END + CAST(k % 4 = 0 AS INT) + 2 * CAST(k % 6 = 0 AS INT) AS score FROM f),
x AS (SELECT file_name, '' AS sheet, unnest(['complexity', 'preparer', 'usage_frequency', 'potential_retirement', 'macros', 'external_links', 'reconciliation']) AS field,
  unnest([CASE WHEN score >= 5 THEN 'High' WHEN score >= 2 THEN 'Medium' ELSE 'Low' END, r_name, NULL, 'not established', CASE WHEN k % 6 = 0 THEN 'yes' ELSE 'no' END, CASE WHEN k % 4 = 0 THEN r_name || ' rates.xlsx' END, 'none found']) AS value,
  unnest(['derived', 'extracted', 'ask', 'ask', 'extracted', 'extracted', 'derived']) AS basis FROM p
 UNION ALL SELECT file_name, 'Customer data', unnest(['visibility', 'category', 'upstream', 'downstream', 'calculation']), unnest(['Visible', 'Input', NULL, 'Summary report (final output)', NULL]), unnest(['extracted', 'derived', 'extracted', 'extracted', 'derived']) FROM p
 UNION ALL SELECT file_name, 'Summary report', unnest(['visibility', 'category', 'upstream', 'downstream', 'calculation']), unnest([CASE WHEN k % 5 = 0 THEN 'Hidden' ELSE 'Visible' END, 'Output', 'Customer data', NULL, 'Prepares figures for a report']), unnest(['extracted', 'derived', 'extracted', 'extracted', 'derived']) FROM p)
SELECT * FROM x
"""



def compound(modules: list[str]) -> bytes:
    """A macro project's compound file as far as its directory goes: the streams are empty, the directory's sectors stand in reverse."""
    none, end = 0xFFFFFFFF, 0xFFFFFFFE
    streams = ["dir", "_VBA_PROJECT", "__SRP_0", *modules]
    children: dict[int, tuple[int, int]] = {}

    def tree(low: int, high: int) -> int:
        if low >= high:
            return none
        middle = (low + high) // 2
        children[middle] = (tree(low, middle), tree(middle + 1, high))
        return middle

    first = tree(3, 3 + len(streams))
    number = lambda *xs: b"".join(x.to_bytes(4, "little") for x in xs)
    entry = lambda name, kind, left, right, child: (name.encode("utf-16-le").ljust(64, b"\0") + (2 * len(name) + 2).to_bytes(2, "little") + bytes([kind, 1]) + number(left, right, child)).ljust(128, b"\0")
    rows = [entry("Root Entry", 5, none, none, 1), entry("VBA", 1, none, 2, first), entry("PROJECT", 2, none, none, none)]
    rows += [entry(name, 2, *children[i], none) for i, name in enumerate(streams, 3)]
    directory = b"".join(rows)
    sectors = [directory[i : i + 512].ljust(512, b"\0") for i in range(0, len(directory), 512)]
    table = number(0xFFFFFFFD, end, *range(1, len(sectors))).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1".ljust(30, b"\0") + (9).to_bytes(2, "little")
    head = head.ljust(48, b"\0") + number(len(sectors))
    return head.ljust(76, b"\0") + number(0) + b"\xff" * 432 + table + b"".join(reversed(sectors))


def _binary_book(rows: pd.DataFrame) -> pd.DataFrame:
    """A workbook with macro modules by market segment, pivot caches of three kinds, a connection, and for some a query."""
    nation, n = rows.iloc[0], len(rows)
    key = int(nation["n_nationkey"])
    modules = ["ThisWorkbook", *(f"Seg_{x}" for x in sorted(set(rows["c_mktsegment"].dropna()))), *(f"Month{i}" for i in range(1, key + 2))]
    cache = lambda source: f'<pivotCacheDefinition xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cacheSource type="worksheet">{source}</cacheSource></pivotCacheDefinition>'.encode()
    sources = [f'<worksheetSource ref="A1:A{n + 1}" sheet="Customer data"/>']
    sources += ['<worksheetSource name="Ledger"/>'] if key % 3 == 0 else []
    sources += [f'<dbPr connection="Server={nation["r_name"]}"/>'] if key % 2 == 0 else []
    parts = {f"xl/pivotCache/pivotCacheDefinition{i}.xml": cache(x) for i, x in enumerate(sources, 1)} | {"xl/vbaProject.bin": compound(modules)}
    if key % 4 == 1:
        parts["customXml/item1.xml"] = b'<DataMashup xmlns="http://schemas.microsoft.com/DataMashup">AAAA</DataMashup>'
    out = io.BytesIO()
    write(out, [Sheet("Customer data", [["Key"], *[[int(x)] for x in sorted(rows["c_custkey"])]])], connections=({"name": nation["r_name"], "connection": "Server=x"},), parts=parts)
    content = out.getvalue()
    return pd.DataFrame([[f"/books/{nation['part']}-{nation['n_name']}.xlsm", len(content), content]], columns=["path", "length", "content"])


def _binary_books(spark: SparkSession, d: str) -> DataFrame:
    with workbook.small_batches(spark):
        return workbook.books(portfolio.spool(workbook.read(_dealt(spark, d, _binary_book))))


_P = f"""c AS (SELECT c_custkey // {RANGE} || '-' || n_name || '.xlsm' AS file_name, n_nationkey AS k, r_name, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT file_name, k, r_name, count(*) AS n FROM c GROUP BY ALL)"""


def workbook_modules(spark: SparkSession, d: str) -> DataFrame:
    """Names of the macro modules, from the directories of compound files."""
    return _binary_books(spark, d).select("file_name", F.explode("vba_modules").alias("module"))


WORKBOOK_MODULES = f"""
WITH {_P} SELECT DISTINCT file_name, 'Seg_' || s AS module FROM c WHERE s IS NOT NULL UNION ALL SELECT file_name, 'ThisWorkbook' FROM f UNION ALL SELECT file_name, 'Month' || unnest(range(1, k + 2)) FROM f
"""


def workbook_pivots(spark: SparkSession, d: str) -> DataFrame:
    """Sources of pivot caches, connections, and whether a file holds a query."""
    names = F.array_join(F.transform("connections", lambda c: c["name"]), ";").alias("connections")
    return _binary_books(spark, d).select("file_name", F.array_join("pivot_sources", ";").alias("pivots"), names, "has_vba", "has_power_query")


WORKBOOK_PIVOTS = f"""
WITH {_P} SELECT file_name, 'Customer data!A1:A' || (n + 1) || CASE WHEN k % 3 = 0 THEN ';Ledger' ELSE '' END || CASE WHEN k % 2 = 0 THEN ';Server=' || r_name ELSE '' END AS pivots,
 r_name AS connections, true AS has_vba, k % 4 = 1 AS has_power_query FROM f
"""

QUERIES = {f.__name__: f for f in (workbook_files, workbook_cells, workbook_regions, workbook_errors, workbook_resume, workbook_fields, workbook_modules, workbook_pivots)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
