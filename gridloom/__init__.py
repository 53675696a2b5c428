"""A spreadsheet-estate analytics engine on PySpark: scan, assess and compare folders of workbooks.

    from gridloom import assess, export_all, scan

    result = assess(scan(spark, "/data/workbooks"))
    export_all(result, "/out")
"""

from gridloom.functions.formulas import analysed as analyse_formula
from gridloom.functions.scalars import column_letters, column_number, range_bounds
from gridloom.operators.detect import detect as detect_regions
from gridloom.operators.graph import connected, sheet_edges
from gridloom.operators.regions import components as find_components
from gridloom.operators.similarity import clusters, estate_pairs, families, insight, offered, shortlist, similar_pairs
from gridloom.plans.portfolio import accepted_claims, assess, findings, fingerprints, narratives, offline, run, save, scan
from gridloom.sinks.portfolio import bundle, export_all, export_tables, write_page
from gridloom.sources.triage import Unreadable
from gridloom.sources.workbook import books, cells, discover, read
from gridloom.streaming.changes import current, watch
from gridloom.streaming.incremental import scan_new

__all__ = [
    "Unreadable", "accepted_claims", "analyse_formula", "assess", "books", "bundle", "cells", "clusters", "column_letters", "column_number", "connected", "current", "detect_regions", "discover", "estate_pairs", "export_all", "export_tables",
    "families", "find_components", "findings", "fingerprints", "insight", "narratives", "offered", "offline", "range_bounds", "read", "run", "save", "scan", "scan_new", "sheet_edges", "shortlist", "similar_pairs", "watch", "write_page",
]
