"""Exports of an assessment: CSV, a workbook, a page, a bundle of originals.  Nothing is sent anywhere."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import spreadsheet_safe
from gridloom.operators import fields as fields_of
from gridloom.plans.fields import FILE_FIELDS, TAB_FIELDS
from gridloom.sinks import xlsx

NOT_ASSESSED = "not assessed: the scan failed"


def text_columns(df: DataFrame) -> DataFrame:
    """Every column as text that is safe in a spreadsheet; lists joined by semicolons."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("array<string"):
            c = F.array_join(c, "; ")
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        return spreadsheet_safe(c.cast("string")).alias(name)

    return df.select(*(shown(n, k) for n, k in df.dtypes))


def summary(t: dict[str, DataFrame]) -> DataFrame:
    """One row a file for reviewers: counts and every assessment field; failed files say so in every field."""
    failed = F.col("parse_status") == "failed"
    say = lambda c: F.when(failed, NOT_ASSESSED).otherwise(F.col(c).cast("string")).alias(c)
    counts = ("n_sheets", "hidden_count", "cached_errors", "review_count")
    files = t["file_fact"].select("file_pk", "file_name", "parse_status", "scan_error", *counts)
    told = fields_of.wide_table(t["file_field"], ["file_pk"], list(FILE_FIELDS))
    out = files.join(told, "file_pk", "left")
    return out.select("file_pk", "file_name", "parse_status", "scan_error", *(say(c) for c in (*counts, *FILE_FIELDS))).orderBy("file_name", "file_pk")


def tabs(t: dict[str, DataFrame]) -> DataFrame:
    """One row a sheet with its fields, visible sheets first."""
    told = fields_of.wide_table(t["tab_field"], ["file_pk", "position", "name", "shown_at"], list(TAB_FIELDS))
    named = told.join(t["file_fact"].select("file_pk", "file_name").dropDuplicates(["file_pk"]), "file_pk")
    order = named.orderBy("file_name", "file_pk", "shown_at")
    return order.select("file_pk", "file_name", "name", (F.col("position") + 1).alias("original_position"), *TAB_FIELDS)


def diagnostics(t: dict[str, DataFrame]) -> DataFrame:
    """Failures, error groups and hidden groups in one table."""
    none = F.lit("")
    name = t["file_fact"].select("file_pk", "file_name").dropDuplicates(["file_pk"])
    a = t["file_fact"].where("parse_status = 'failed'").select("file_pk", F.lit("Scan failure").alias("kind"), none.alias("sheet"), none.alias("what"), F.lit(0).cast("long").alias("count"), none.alias("area"), none.alias("downstream"), none.alias("recalculate"), F.lit("mend the file and resume the run").alias("action"), F.col("scan_error").alias("detail"))
    b = t["error_group"].select("file_pk", F.lit("Cached error"), "sheet", F.concat_ws(" in ", "error", "region"), "count", "area_type", F.array_join("downstream_outputs", "; "), F.when(F.col("recalc_required"), "yes").otherwise("no"), "reviewer_action", F.array_join("sample_cells", "; "))
    c = t["hidden_group"].select("file_pk", F.lit("Hidden sheets"), none, "purpose", "count", none, F.array_join("depended_on_by", "; "), none, F.lit("find out who needs them"), F.array_join("sheets", "; "))
    return a.union(b).union(c).join(name, "file_pk", "left").select("file_pk", "file_name", "kind", "sheet", "what", "count", "area", "downstream", "recalculate", "action", "detail").orderBy("file_name", "file_pk", "kind", F.desc("count"), "sheet", "what")


def export_tables(result: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four tables that reviewers get."""
    return {
        "file_summary": summary(result),
        "worksheet_details": tabs(result),
        "portfolio_findings": result["finding"].orderBy(F.when(F.col("severity") == "High", 0).otherwise(1), F.desc("files"), "category", "finding"),
        "diagnostics": diagnostics(result),
    }


def write_csv(df: DataFrame, path: Path) -> None:
    """A reviewer's CSV with a byte order mark; rows come one partition at a time and go straight to the file."""
    with path.open("w", newline="", encoding="utf-8-sig") as out:
        w = csv.writer(out)
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if x is None else x for x in r])


def export_all(result: dict[str, DataFrame], folder: str) -> list[Path]:
    """Four CSV files and one workbook with the same four tables."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    shown = {k: text_columns(df) for k, df in export_tables(result).items()}
    out = []
    for k, df in shown.items():
        out.append(target / f"{k}.csv")
        write_csv(df, out[-1])
    out.append(target / "portfolio_review.xlsx")
    xlsx.write(out[-1], [xlsx.table_sheet(k.replace("_", " "), df) for k, df in shown.items()])
    return out


def write_page(path: str | Path, title: str, tables: dict[str, DataFrame], drawn: Iterable[str] = ()) -> None:
    """A page without scripts or outside parts: one table each, all text escaped, written row by row; then what is ``drawn``, piece by piece."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style></head><body><h1>{html.escape(title)}</h1>")
        for k, df in tables.items():
            out.write(f"<h2>{html.escape(k)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
            for r in text_columns(df).toLocalIterator():
                out.write("<tr>" + "".join(f"<td>{html.escape('—' if x is None else str(x))}</td>" for x in r) + "</tr>")
            out.write("</table>")
        for piece in drawn:
            out.write(piece)
        out.write("</body></html>")


def bundle(target: str, originals: dict[str, tuple[str, str]], tables: dict[str, DataFrame]) -> None:
    """Originals, as (path, sha256) by name, and tables in one archive; refuses a source that has changed since its scan."""
    for file_name, (path, sha) in originals.items():
        if hashlib.sha256(Path(path).read_bytes()).hexdigest() != sha:
            raise ValueError(f"{file_name} has changed since it was scanned")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file_name, (path, _) in originals.items():
            z.write(path, f"originals/{file_name}")
        for k, df in tables.items():
            with z.open(f"analysis/{k}.csv", "w") as part, io.TextIOWrapper(part, "utf-8-sig", newline="") as out:
                w = csv.writer(out)
                w.writerow(df.columns)
                for r in text_columns(df).toLocalIterator():
                    w.writerow(["" if x is None else x for x in r])
