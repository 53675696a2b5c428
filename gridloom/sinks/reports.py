"""Reports on one file and on an estate: workbooks, pages and CSV."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import regions
from gridloom.plans import endpoints
from gridloom.sinks import xlsx
from gridloom.sinks.portfolio import text_columns, write_csv, write_page

Tables = dict[str, DataFrame]
NOTHING = "—"


def shown(value: object) -> str:
    """A nested value as a reviewer reads it: nothing is a dash, lists are joined, a verdict comes before its details."""
    if value is None or value == [] or value == {}:
        return NOTHING
    if isinstance(value, bool):
        return "Yes" if value else "No"
    if isinstance(value, list | tuple):
        return "; ".join(map(shown, value))
    if isinstance(value, dict):
        if "verdict" in value:
            more = [f"{k}: " + ", ".join(map(label, value[k])) for k in ("matches", "candidates", "opportunities", "drivers", "signals") if value.get(k)]
            return str(value["verdict"]) + (" — " + "; ".join(more) if more else "")
        if "final_business_deliverables" in value:
            return "; ".join(value["final_business_deliverables"]) or str(value.get("status", NOTHING))
        return json.dumps(value, default=str)
    return str(value)


def label(item: object) -> str:
    """A short name of a list's item."""
    if isinstance(item, dict):
        return str(next((item[k] for k in ("file", "worksheet", "sheet", "file_name", "name", "proposed_change") if item.get(k)), json.dumps(item, default=str)))
    return str(item)


def plate(cells: Column) -> Column:
    """The upper left corner of a sheet as lines of flags, a dot for an empty cell."""
    wide, tall = F.array_max(F.transform(cells, lambda x: x["c"])), F.array_max(F.transform(cells, lambda x: x["r"]))
    at = F.map_from_entries(F.transform(cells, lambda x: F.struct(x["r"] * 1000 + x["c"], x["flag"].cast("string"))))
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(1), wide), lambda c: F.coalesce(F.try_element_at(at, r * 1000 + c), F.lit("."))), "")
    return F.when(F.size(cells) > 0, F.array_join(F.transform(F.sequence(F.lit(1), tall), line), "\n"))


#: Colours of the flags: values, formulas, errors, texts.
COLOURS = {1: "#7fb3a6", 2: "#4a6fa5", 3: "#c0392b", 4: "#c9c4b5"}


def plates(t: Tables, file_pk: str) -> DataFrame:
    """The corners of a file's sheets as rectangles of one flag, in drawing order; a sheet without cells has one row without a rectangle."""
    corner = t["occupancy"].where(F.col("file_pk") == file_pk).select("position", "truncated", F.explode("occupancy").alias("x")).select("position", "truncated", F.col("x.r").alias("row"), F.col("x.c").alias("col"), "x.flag")
    boxes = regions.plates(corner, ["position", "truncated"])
    names = t["sheet"].where(F.col("file_pk") == file_pk).select("position", "name")
    return names.join(boxes, "position", "left").orderBy("position", "r1", "c1", "flag")


def drawing(rows: Iterable, side: int = 6) -> Iterator[str]:
    """Rows of ``plates`` as drawings, a piece a row: nothing but the row at hand is held."""
    open_at = None
    for r in rows:
        if r["position"] != open_at:
            if open_at is not None:
                yield "</svg>"
            open_at = r["position"]
            more = ": upper left corner" if r["truncated"] else ""
            yield f"<h3>{html.escape(r['name'])}{more}</h3><svg width='{60 * side}' height='{120 * side}' viewBox='0 0 60 120' role='img'>"
        if r["r1"] is not None:
            yield f"<rect x='{r['c1'] - 1}' y='{r['r1'] - 1}' width='{r['c2'] - r['c1'] + 1}' height='{r['r2'] - r['r1'] + 1}' fill='{COLOURS[r['flag']]}'/>"
    if open_at is not None:
        yield "</svg>"


def file_tables(t: Tables, file_pk: str) -> Tables:
    """The sheets of a file's report, by title."""
    own = endpoints.file(t, file_pk)
    facts = own["sheet_fact"].orderBy("place")
    pk = F.col("file_pk") == file_pk
    shape = t["formula"].where(pk).groupBy("sheet", "skeleton").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "sheet", "skeleton")
    book = t["workbook"].where(pk)
    return {
        "File assessment": t["file_field"].where(pk).orderBy("place").select("field", "value", "basis", "confidence", "evidence"),
        "Worksheet assessment": t["tab_field"].where(pk).orderBy("shown_at", "place").select("name", "field", "value", "basis", "confidence", "evidence"),
        "Sheet inventory": facts.select("name", "visibility", "populated", "max_row", "max_col", "density", "formulas", "distinct_skeletons", "n_errors"),
        "Occupancy": t["occupancy"].where(pk).orderBy("position").select("position", "truncated", F.size("occupancy").alias("cells_shown"), plate(F.col("occupancy")).alias("plate")),
        "Regions": own["region"].orderBy("position", "region_id").select("position", "ref", "kind", "origin", "headers", "n_data_rows", "density", "detect_confidence", "evidence"),
        "Formula patterns": shape,
        "Errors": own["error_group"].orderBy(F.desc("count"), "sheet", "error"),
        "Hidden sheets": own["hidden_group"].orderBy(F.desc("count"), "purpose"),
        "Input sources": book.select("external_links", "connections.name", "pivot_sources"),
        "Calculations": facts.where("description is not null").select("name", "description"),
        "Opportunities": t["simplification"].where(F.col("file") == file_pk),
        "Warnings": book.select(F.explode("warnings").alias("warning")),
        "Similar files": own["pair"].orderBy(F.desc("overall"), "a", "b"),
    }


def write_file_report(t: Tables, file_pk: str, path: str) -> None:
    """The report as a workbook."""
    xlsx.write(path, [xlsx.table_sheet(k, text_columns(df)) for k, df in file_tables(t, file_pk).items()])


def write_file_page(t: Tables, file_pk: str, path: str) -> None:
    """The report as a page, with the sheets' occupancy drawn."""
    parts = file_tables(t, file_pk)
    parts["Occupancy"] = parts["Occupancy"].drop("plate")
    write_page(path, f"Workbook {file_pk}", parts, drawing(plates(t, file_pk).toLocalIterator()))


def estate_tables(t: Tables) -> Tables:
    """Linked pairs and families."""
    return {"Linked pairs": t["estate"].orderBy(F.desc("overall"), "a", "b"), "Families": t["family"].orderBy(F.desc("size"), "cluster")}


def write_estate(t: Tables, folder: str) -> list[Path]:
    """Pairs as CSV, pairs and families as a workbook and as a page."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    parts = estate_tables(t)
    out = [target / "estate_pairs.csv", target / "estate.xlsx", target / "estate.html"]
    write_csv(text_columns(parts["Linked pairs"]), out[0])
    xlsx.write(out[1], [xlsx.table_sheet(k, text_columns(df)) for k, df in parts.items()])
    write_page(out[2], "Estate", parts)
    return out
