"""Command line: scan a folder of workbooks, compare them, and write what reviewers need.

    python -m gridloom scan FOLDER -o RUN            tables of the run as Parquet, review tables as CSV and xlsx
    python -m gridloom scan FOLDER -o RUN --resume   only files that are new, changed or failed before
    python -m gridloom report RUN FILE -o OUT        one file's report, as a workbook or a page
    python -m gridloom estate RUN -o OUT             the comparison of all files
    python -m gridloom find RUN [TEXT]               files by name and scan status
    python -m gridloom compare RUN FILE FILE...      chosen files side by side
    python -m gridloom export RUN TABLE              a table as JSON lines
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import endpoints, portfolio
from gridloom.sinks import portfolio as review
from gridloom.sinks import reports, tables
from gridloom.sources import workbook


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridloom", description="Reads folders of spreadsheet workbooks and says what is in them.")
    out.add_argument("--master", default=None, help="Spark master; local[*] where neither this nor the environment names one")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=text, description=text)

    scan = command("scan", "scan and assess all workbooks below a folder")
    scan.add_argument("folder")
    scan.add_argument("-o", "--out", required=True, help="folder of the run")
    scan.add_argument("--max-rows", type=int, default=workbook.MAX_ROWS, help="rows that are read of a sheet; a sheet with more is marked as truncated")
    scan.add_argument("--resume", action="store_true", help="scan only what is new, changed or failed since the run's last scan")
    report = command("report", "write the report of one file")
    report.add_argument("run")
    report.add_argument("file", help="a file's name or key")
    report.add_argument("-o", "--out", required=True)
    report.add_argument("--format", choices=("xlsx", "html"), default="xlsx")
    estate = command("estate", "write the comparison of all files")
    estate.add_argument("run")
    estate.add_argument("-o", "--out", required=True)
    find = command("find", "list files by a part of their name and by scan status")
    find.add_argument("run")
    find.add_argument("text", nargs="?", default="")
    find.add_argument("--status", default="")
    find.add_argument("--page", type=int, default=1)
    find.add_argument("--size", type=int, default=50)
    compare = command("compare", "show chosen files side by side")
    compare.add_argument("run")
    compare.add_argument("files", nargs="+")
    export = command("export", "print a table of the run as JSON lines")
    export.add_argument("run")
    export.add_argument("table")
    return out


def session(master: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("gridloom").config("spark.sql.session.timeZone", "UTC")
    if master or not (os.environ.get("MASTER") or os.environ.get("SPARK_MASTER")):
        builder = builder.master(master or "local[*]")
    return builder.getOrCreate()


def saved(spark: SparkSession, run: str) -> dict[str, DataFrame]:
    """The tables of a run's folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/tables")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise SystemExit(f"{run} holds no run")
    names = sorted(x.getPath().getName() for x in system.listStatus(path) if x.isDirectory())
    return {n: spark.read.parquet(f"{run}/tables/{n}") for n in names}


def key_of(result: dict[str, DataFrame], file: str) -> str:
    """The key of the one file with this name or key."""
    rows = result["workbook"].where((result["workbook"]["file_pk"] == file) | (result["workbook"]["file_name"] == file)).select("file_pk").limit(2).collect()
    if len(rows) != 1:
        raise SystemExit(f"{len(rows) or 'no'} file(s) by the name {file}")
    return rows[0]["file_pk"]


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = session(given.master)
    if given.command == "scan":
        before = saved(spark, given.out) if given.resume else None
        result = portfolio.run(spark, given.folder, given.max_rows, before)
        portfolio.save(result, given.out)
        for path in review.export_all(saved(spark, given.out), str(Path(given.out) / "review")):
            print(path)
        return 0
    result = saved(spark, given.run)
    if given.command == "report":
        write = reports.write_file_report if given.format == "xlsx" else reports.write_file_page
        write(result, key_of(result, given.file), given.out)
        print(given.out)
    elif given.command == "estate":
        for path in reports.write_estate(result, given.out):
            print(path)
    elif given.command == "find":
        for line in tables.json_lines(endpoints.files(result, given.text, given.status, (given.page - 1) * given.size, given.size)).toLocalIterator():
            print(line[0])
    elif given.command == "compare":
        for line in tables.json_lines(endpoints.compare(result, [key_of(result, f) for f in given.files])).toLocalIterator():
            print(line[0])
    elif given.table not in result:
        raise SystemExit(f"tables: {', '.join(result)}")
    else:
        for line in tables.json_lines(result[given.table]).toLocalIterator():
            print(line[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
