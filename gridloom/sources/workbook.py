"""Workbook packages as tables: structure and cells, read in Python workers one file at a time.

Packages are zip files of XML; sheets are parsed as streams, so memory holds one file's
shared strings and a batch of cells, whatever the sheet's length.  A file is opened once:
one pass gives its cells, and then a row about the file.  A file that cannot
be read gives a row with its reason, never a failed job.

A Power Query is told by the first ``QUERY_HEAD`` bytes of a custom part, where its element's name stands.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.triage import Unreadable, opened

MAX_ROWS = 200_000
BATCH, QUERY_HEAD = 50_000, 400
#: Files, and bytes of them, that go to a Python worker at once.
FILES_AT_ONCE, BYTES_AT_ONCE = 16, 64 << 20
# Extensions, error values and the date formats of the workbook format.
EXTENSIONS = ("xlsx", "xlsm", "xltx", "xltm")
ERRORS = ("#REF!", "#N/A", "#DIV/0!", "#VALUE!", "#NAME?", "#NULL!", "#NUM!", "#SPILL!", "#CALC!")
DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57))

STRUCTURE = """file_pk string, path string, file_name string, size_bytes long, sha256 string, parse_status string, error_category string, scan_error string,
creator string, last_modified_by string, created string, modified string, title string, application string, company string, has_vba boolean, vba_modules array<string>, has_power_query boolean,
external_links array<string>, pivot_sources array<string>, connections array<struct<name:string,type:string,description:string,connection_string:string,command:string>>,
defined_names array<struct<name:string,refers_to:string>>, warnings array<string>,
sheets array<struct<position:int,name:string,state:string,truncated:boolean,dimension:string,merges:array<string>,has_autofilter:boolean,n_formats:int,n_validations:int,hyperlinks:array<string>,
tables:array<struct<name:string,display_name:string,ref:string,header_rows:int,totals_rows:int,columns:array<string>>>>>"""
CELLS = "file_pk string, position int, sheet string, row int, col int, value string, formula string, text string, is_text boolean, is_number boolean, is_date boolean, is_error boolean, bold boolean, filled boolean, bordered boolean"


def discover(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime and content of the workbook files below a path; temporary and own files left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    wanted = F.lower(name).rlike(rf"\.({'|'.join(EXTENSIONS)})$") & ~name.rlike(r"^(~\$|\.)")
    return found.where(wanted & ~F.col("path").rlike(r"/(gridloom_[^/]*|\.git|\.venv|__pycache__)/"))


def local(tag: str) -> str:
    """A tag without its namespace; strict and transitional packages read alike."""
    return tag.rpartition("}")[2]


def attribute(element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in element.attrib.items() if local(k) == name), None)


class Package:
    """One opened workbook: its parts, relations and sheets."""

    def __init__(self, content: bytes):
        self.zip = opened(content)
        self.names = set(self.zip.namelist())
        self.book = self.root("xl/workbook.xml")
        if self.book is None:
            raise Unreadable("the workbook part is no XML", "corrupt")
        self.relations = self.related("xl/workbook.xml")
        sheets = [e for e in self.book.iter() if local(e.tag) == "sheet"]
        self.strings, self.formats = self.shared_strings(), self.styles()
        self.sheets = [(i, e.get("name") or f"Sheet{i + 1}", e.get("state") or "visible", self.relations.get(attribute(e, "id"), "")) for i, e in enumerate(sheets)]

    def root(self, part: str):
        """The parsed part, None where it is missing or damaged."""
        if part not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.zip.read(part))
        except (ElementTree.ParseError, OSError, ValueError):
            return None

    def related(self, part: str) -> dict[str, str]:
        """Relation id to part; targets outside the package as they are."""
        folder, name = posixpath.split(part)
        root = self.root(f"{folder}/_rels/{name}.rels")
        out = {}
        for e in root if root is not None else ():
            target = e.get("Target") or ""
            inside = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[e.get("Id")] = target if e.get("TargetMode") == "External" else inside
        return out

    def elements(self, part: str) -> Iterator:
        """The part's elements as they end; the caller clears what it has used."""
        with self.zip.open(part) as stream:
            try:
                for _, e in ElementTree.iterparse(stream):
                    yield e
            except ElementTree.ParseError:
                return

    def properties(self, part: str, names: dict[str, str]) -> dict[str, str | None]:
        root = self.root(part)
        found = {local(e.tag): (e.text or "").strip() or None for e in (root if root is not None else ())}
        return {k: found.get(v) for k, v in names.items()}

    def connections(self) -> list[dict]:
        root = self.root("xl/connections.xml")
        out = []
        for e in root if root is not None else ():
            db = next((c for c in e if local(c.tag) == "dbPr"), None)
            out.append({k: e.get(k) for k in ("name", "type", "description")} | {"connection_string": db.get("connection") if db is not None else None, "command": db.get("command") if db is not None else None})
        return out

    def pivots(self) -> list[str]:
        out = []
        for part in sorted(n for n in self.names if re.fullmatch(r"xl/pivotCache/pivotCacheDefinition\d+\.xml", n)):
            for e in root.iter() if (root := self.root(part)) is not None else ():
                if local(e.tag) == "worksheetSource":
                    ref = e.get("ref") or e.get("name") or ""
                    out.append(f"{e.get('sheet')}!{ref}" if e.get("sheet") else ref)
                elif local(e.tag) in ("dbPr", "connection") and e.get("connection"):
                    out.append(e.get("connection"))
        return out

    def links(self) -> list[str]:
        parts = [p for p in self.relations.values() if "externalLink" in p]
        targets = [t for p in parts for t in self.related(p).values()]
        return [t for t in targets if re.match(r"http|file:|/|\\|.{1,2}:", t)]

    def power_query(self) -> bool:
        return any(b"DataMashup" in self.zip.read(n)[:QUERY_HEAD] for n in self.names if re.fullmatch(r"customXml/item[^/]*\.xml", n))

    def modules(self) -> list[str]:
        """Names of the macro project's modules; code is never read."""
        return module_names(self.zip.read("xl/vbaProject.bin")) if "xl/vbaProject.bin" in self.names else []

    def sheet_structure(self, part: str) -> dict:
        """Merges, filters, validations, links and declared tables of a sheet."""
        out = {"dimension": None, "merges": [], "has_autofilter": False, "n_formats": 0, "n_validations": 0, "hyperlinks": [], "tables": []}
        tables = []
        for e in self.elements(part):
            tag = local(e.tag)
            if tag == "dimension":
                out["dimension"] = e.get("ref")
            elif tag == "mergeCell" and e.get("ref"):
                out["merges"].append(e.get("ref"))
            elif tag == "autoFilter":
                out["has_autofilter"] = True
            elif tag == "conditionalFormatting":
                out["n_formats"] += 1
            elif tag == "dataValidation":
                out["n_validations"] += 1
            elif tag == "hyperlink" and (target := e.get("location") or attribute(e, "id")):
                out["hyperlinks"].append(target)
            elif tag == "tablePart":
                tables.append(attribute(e, "id"))
            elif tag == "row":
                e.clear()
        relations = self.related(part) if tables else {}
        for i in tables:
            if (root := self.root(relations.get(i, ""))) is not None:
                columns = [e.get("name") or "" for e in root.iter() if local(e.tag) == "tableColumn"]
                count = lambda k, d: int(root.get(k) or d)  # noqa: B023, E731
                out["tables"].append({"name": root.get("name") or "", "display_name": root.get("displayName") or "", "ref": root.get("ref") or "", "header_rows": count("headerRowCount", 1), "totals_rows": count("totalsRowCount", 0), "columns": columns})
        return out

    def shared_strings(self) -> list[str]:
        root = self.root("xl/sharedStrings.xml")
        return ["".join(t.text or "" for t in e.iter() if local(t.tag) == "t") for e in (root if root is not None else ()) if local(e.tag) == "si"]

    def styles(self) -> list[tuple[bool, bool, bool, bool]]:
        """bold, filled, bordered and date of each cell format."""
        root = self.root("xl/styles.xml")
        part = {local(e.tag): e for e in (root if root is not None else ())}
        bold = [any(local(c.tag) == "b" for c in f) for f in part.get("fonts", ())]
        filled = [any(local(c.tag) == "patternFill" and (c.get("patternType") or "none") != "none" for c in f) for f in part.get("fills", ())]
        edged = [any(local(c.tag) in ("top", "bottom") and c.get("style") for c in b) for b in part.get("borders", ())]
        dates = {int(f.get("numFmtId") or 0) for f in part.get("numFmts", ()) if date_code(f.get("formatCode") or "")}
        pick = lambda of, i: of[i] if i < len(of) else False
        out = []
        for x in part.get("cellXfs", ()):
            n = lambda k: int(x.get(k) or 0)  # noqa: B023, E731
            out.append((pick(bold, n("fontId")), pick(filled, n("fillId")), pick(edged, n("borderId")), n("numFmtId") in DATE_FORMATS or n("numFmtId") in dates))
        return out


def module_names(project: bytes) -> list[str]:
    """The streams in the VBA storage of a compound file, but for those that hold no module; none where it is damaged."""
    word = lambda at, n: int.from_bytes(project[at : at + n], "little")
    if project[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(project) < 512:
        return []
    size = 1 << min(word(30, 2), 16)
    sector = lambda i: project[(i + 1) * size : (i + 2) * size]
    table = b"".join(sector(i) for k in range(109) if (i := word(76 + 4 * k, 4)) < 0xFFFFFFFA)
    chain, at, seen = b"", word(48, 4), set()
    while at < 0xFFFFFFFA and at not in seen:
        seen.add(at)
        chain += sector(at)
        at = int.from_bytes(table[4 * at : 4 * at + 4] or b"\xff" * 4, "little")
    entries = [chain[i : i + 128] for i in range(0, len(chain) - 127, 128)]
    field = lambda e, a: int.from_bytes(e[a : a + 4], "little")
    title = lambda e: e[: max(0, int.from_bytes(e[64:66], "little") - 2)].decode("utf-16-le", "replace")
    out = []
    for e in entries:
        # a storage's children are a tree of siblings
        todo, done = ([field(e, 76)] if e[66] == 1 and title(e) == "VBA" else []), set()
        while todo:
            i = todo.pop()
            if i < len(entries) and i not in done:
                done.add(i)
                todo += [field(entries[i], 68), field(entries[i], 72)]
                name = title(entries[i])
                if entries[i][66] == 2 and name not in ("dir", "_VBA_PROJECT") and not name.startswith("__SRP_"):
                    out.append(name)
    return sorted(set(out))


def date_code(code: str) -> bool:
    """Does a number format render a date: any of y m d h s outside quotes and brackets?"""
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"?|\[[^\]]*\]?', "", code.lower())))


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def shown(x: float) -> str:
    """A number as text, whole ones without a fraction."""
    return str(int(x)) if x.is_integer() and abs(x) < 1e17 else repr(x)


def cells_of(package: Package, part: str, max_rows: int, left_out: list | None = None) -> Iterator[tuple]:
    """row, col, value, formula, text and flags of a sheet's cells; the first row beyond ``max_rows`` joins ``left_out``."""
    shared, styles = package.strings, package.formats
    row = col = 0
    for e in package.elements(part):
        tag = local(e.tag)
        if tag == "row":
            e.clear()
        if tag != "c":
            continue
        if m := re.fullmatch(r"([A-Za-z]+)([0-9]+)", e.get("r") or ""):
            row, col = int(m[2]), 0
            for c in m[1].upper():
                col = col * 26 + ord(c) - 64
        else:
            row, col = row or 1, col + 1
        if row > max_rows:
            if left_out is not None and not left_out:
                left_out.append(row)
            continue
        kind, style = e.get("t"), int(e.get("s") or 0)
        child = {local(c.tag): c for c in e}
        raw = child["v"].text if "v" in child else None
        formula = "=" + (child["f"].text or "") if "f" in child else None
        bold, filled, bordered, dated = styles[style] if style < len(styles) else (False,) * 4
        value, is_number = raw, False
        if kind == "s":
            at = int(raw) if raw else -1
            value = shared[at] if 0 <= at < len(shared) else ""
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in child["is"].iter() if local(t.tag) == "t") if "is" in child else ""
        elif kind == "b":
            value = "TRUE" if raw == "1" else "FALSE"
        elif kind not in ("str", "e", "d") and raw:
            x = number(raw)
            is_number, value = x is not None, raw if x is None else shown(x)
        elif kind not in ("str", "e", "d"):
            value = None
        if value is None and formula is None:
            continue
        is_date = kind == "d" or (is_number and dated)
        is_string = value is not None and not is_number and kind not in ("b", "d")
        yield row, col, value, formula, value if is_string else "", is_string and not value.startswith("="), is_number and not is_date, is_date, is_string and value in ERRORS, bold, filled, bordered


def _empty(path: str, content: bytes, sha: str) -> dict:
    base = {"file_pk": sha[:12], "path": path, "file_name": path.rpartition("/")[2], "size_bytes": len(content), "sha256": sha, "parse_status": "full", "error_category": None, "scan_error": None, "warnings": []}
    lists = {k: [] for k in ("external_links", "pivot_sources", "connections", "defined_names", "sheets", "vba_modules")}
    return base | lists | dict.fromkeys(("creator", "last_modified_by", "created", "modified", "title", "application", "company")) | {"has_vba": False, "has_power_query": False}


def _described(p: Package, out: dict, truncated: dict[int, int]) -> dict:
    """What the package says of the file. truncated: by position, the first row that was not read."""
    core = p.properties("docProps/core.xml", {"creator": "creator", "last_modified_by": "lastModifiedBy", "created": "created", "modified": "modified", "title": "title"})
    app = p.properties("docProps/app.xml", {"application": "Application", "company": "Company"})
    for position, name, state, part in p.sheets:
        if part not in p.names:
            out["warnings"].append(f"sheet {name!r} has no part")
            out["parse_status"] = "partial"
            continue
        if position in truncated:
            out["warnings"].append(f"sheet {name!r}: rows from {truncated[position]} on were not read")
            out["parse_status"] = "partial"
        out["sheets"].append({"position": position, "name": name, "state": state, "truncated": position in truncated} | p.sheet_structure(part))
    if app["application"] and "Excel" not in app["application"]:
        out["warnings"].append("last written by another application: cached values may be missing")
    names = [{"name": e.get("name") or "", "refers_to": (e.text or "").strip()} for e in p.book.iter() if local(e.tag) == "definedName"]
    return out | core | app | {"has_vba": "xl/vbaProject.bin" in p.names, "vba_modules": p.modules(), "has_power_query": p.power_query(), "external_links": p.links(), "pivot_sources": p.pivots(), "connections": p.connections(), "defined_names": names}


def opened_once(path: str, content: bytes, sha: str, max_rows: int) -> Iterator[tuple[list[tuple], dict | None]]:
    """Batches of cells, each with None, and in the end no cells with the row about the file."""
    out, truncated = _empty(path, content, sha), {}
    try:
        p = Package(content)
        for position, name, _, part in p.sheets:
            rows, left_out = [], []
            for c in cells_of(p, part, max_rows, left_out) if part in p.names else ():
                rows.append((sha[:12], position, name, *c))
                if len(rows) == BATCH:
                    yield rows, None
                    rows = []
            if left_out:
                truncated[position] = left_out[0]
            if rows:
                yield rows, None
        yield [], _described(p, out, truncated)
    except Unreadable as e:
        yield [], _empty(path, content, sha) | {"parse_status": "failed", "error_category": e.category, "scan_error": str(e)}
    except Exception as e:  # noqa: BLE001  one bad file must not end the run
        yield [], _empty(path, content, sha) | {"parse_status": "failed", "error_category": "corrupt", "scan_error": type(e).__name__}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within: few files go to a Python worker at once, whatever the session's settings are."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": FILES_AT_ONCE, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_AT_ONCE}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read(files: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The columns of a cell, and book: rows of cells have no book, and a file's last row has no cell.

    files: path, content, and sha, the content's SHA-256.
    """
    schema = T.StructType([*T.StructType.fromDDL(CELLS), T.StructField("book", T.StructType.fromDDL(STRUCTURE))])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for rows, book in opened_once(r.path, bytes(r.content or b""), r.sha, max_rows):
                    if book is None:
                        yield pd.DataFrame(rows, columns=names[:-1]).assign(book=None)[names]
                    else:
                        yield pd.DataFrame([[*[None] * (len(names) - 1), book]], columns=names)

    return files.select("path", "content", "sha").mapInPandas(run, schema)


def hashed(files: DataFrame) -> DataFrame:
    """The files with sha, the SHA-256 of their content."""
    return files.withColumn("sha", F.sha2("content", 256))


def books(found: DataFrame) -> DataFrame:
    """One row a file: properties, links, sheets; failed files with category and reason."""
    return found.where("book is not null").select("book.*")


def cells(found: DataFrame) -> DataFrame:
    """One row a populated cell, of files that can be read."""
    return found.where("book is null").drop("book")
