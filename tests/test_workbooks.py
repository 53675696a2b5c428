"""Reading packages, detecting regions, assessing and exporting, end to end."""

import csv
import io
import zipfile

import pytest
from books import HEADERS, STOCK, TRUTH, counted, depot_sheets, write_estate
from gridloom.operators import detect
from gridloom.plans import portfolio
from gridloom.sinks import portfolio as sinks
from gridloom.sinks import reports
from gridloom.sources import triage, workbook
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("estate")
    write_estate(out)
    return out


@pytest.fixture(scope="session")
def tables(spark, folder):
    return portfolio.scan(spark, str(folder))


@pytest.fixture(scope="session")
def result(tables):
    return portfolio.assess(tables)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def of_depot(t, name):
    pk = t["workbook"].where("file_name = 'depot.xlsx'").first()["file_pk"]
    return t[name].where(F.col("file_pk") == pk)


def test_discovery_and_triage(tables):
    assert sorted(rows(tables["workbook"], "file_name", "parse_status", "error_category")) == [("broken.xlsx", "failed", "not_ooxml"), ("copy of depot.xlsm", "full", None), ("depot.xlsx", "full", None), ("rates.xlsx", "full", None)]


@pytest.mark.parametrize(("content", "category"), [(b"", "empty"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"x" * 9, "legacy_ole"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "EncryptedPackage".encode("utf-16-le"), "encrypted"), (b"PK\x03\x04zz", "corrupt"), (b"text", "not_ooxml")])
def test_unreadable(content, category):
    with pytest.raises(triage.Unreadable) as e:
        triage.opened(content)
    assert e.value.category == category


def test_package_without_workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(triage.Unreadable) as e:
        triage.opened(out.getvalue())
    assert e.value.category == "not_workbook"


def test_cells_and_types(tables):
    cell = of_depot(tables, "cell")
    assert (cell.count(), cell.where("formula is not null").count()) == counted(depot_sheets())
    d6 = cell.where("sheet = 'Plan calc' and row = 6 and col = 4").first()
    assert (d6["formula"], d6["value"], d6["is_number"]) == ("=C6*(1-Settings!$C$6)", "886.5", True)
    bad = cell.where("is_error").collect()
    assert [(r["sheet"], r["row"], r["col"], r["text"]) for r in bad] == [("Plan calc", 9, 11, "#DIV/0!")]
    assert of_depot(tables, "formula").where("sheet = 'Plan calc' and row = 6 and col = 4").first()["skeleton"] == "RC[-1]*(N-SHEET!R6C3)"
    head = cell.where("sheet = 'Stock data' and row = 3 and col = 1").first()
    assert head["bold"] and head["filled"] and head["is_text"]


def test_regions_against_truth(tables):
    names = of_depot(tables, "sheet").select("file_pk", "position", "name")
    found = {(r["name"], r["ref"]): r for r in of_depot(tables, "region").join(names, ["file_pk", "position"]).collect()}
    assert set(found) == set(TRUTH)
    wrong = [k for k in TRUTH if found[k]["kind"] != TRUTH[k]]
    assert len(wrong) <= 2 and all(found[k]["detect_confidence"] < 0.70 for k in wrong), wrong
    for k, heads in HEADERS.items():
        assert found[k]["headers"] == heads
    assert found["Plan calc", "B4:H15"]["totals_row"] == 15
    columns = {c["col"]: c["inferred_type"] for c in found["Stock data", "A3:E27"]["columns"]}
    assert columns == {1: "text", 2: "text", 3: "number", 4: "number", 5: "number"}


def test_labels_under_bands_of_several_rows(spark):
    key = ("f", 0, 1)
    cell = [(1, 1, "2024"), (1, 5, "Notes"), (2, 1, "H1"), (2, 3, "H2"), (3, 1, "In"), (3, 2, "Out"), (3, 3, "In"), (3, 5, "Text"), (4, 1, "x")]
    cells = spark.createDataFrame([(*key, *c) for c in cell], "file_pk string, position int, region_id int, row int, col int, text string")
    # A9:B9 lies below the region, C1:C4 spans rows
    sheets = spark.createDataFrame([("f", 0, ["A1:D1", "A2:B2", "C2:D2", "A9:B9", "C1:C4", "junk"])], "file_pk string, position int, merges array<string>")
    found = spark.createDataFrame([(*key, 1, 5, 8, 1, {1: 2, 2: 2, 3: 4, 4: 1}), ("f", 0, 2, 1, 2, 1, 1, {1: 2}), ("f", 0, 3, 1, 2, 5, None, {1: 2})], "file_pk string, position int, region_id int, left int, right int, bottom int, header_row int, filled map<int,bigint>")
    out = {r["region_id"]: r for r in detect.merged_headers(found, detect.bands(sheets), cells).collect()}
    assert out[1]["label_row"] == 3 and out[1]["labels"] == ["2024::H1::In", "2024::H1::Out", "2024::H2::In", "", "Text"] and out[1]["blanks"] == 1
    # a region of one row has no row below its bands, and one without a header row has no labels
    assert out[2]["label_row"] == 1 and out[2]["labels"] == ["", ""] and 3 not in out
    # a row below that is less full does not take the header's place
    thin = detect.merged_headers(found.where("region_id = 1").withColumn("filled", F.expr("map(1, 3L, 2, 2L, 3, 4L)")), detect.bands(sheets), cells).first()
    assert thin["label_row"] == 1 and thin["labels"] == ["2024", "", "", "", "Notes"]


def test_plates_cover_a_whole_corner_cell_by_cell(spark):
    flag = lambda r, c: 3 if (r * c) % 11 == 0 else 2 if c > 40 else 4 if r < 9 else 1 if r % 10 else None
    cells = {(r, c): flag(r, c) for r in range(1, 121) for c in range(1, 61)}
    cell = "array<struct<r:int,c:int,flag:int>>"
    table = spark.createDataFrame([("f", 0, False, [(*at, x) for at, x in cells.items() if x]), ("f", 1, None, [])], f"file_pk string, position int, truncated boolean, occupancy {cell}")
    names = spark.createDataFrame([("f", 0, "A & B"), ("f", 1, "Empty"), ("g", 0, "Other")], "file_pk string, position int, name string")
    found = reports.plates({"occupancy": table, "sheet": names}, "f").collect()
    drawn = {}
    for p in found[:-1]:
        for at in ((r, c) for r in range(p["r1"], p["r2"] + 1) for c in range(p["c1"], p["c2"] + 1)):
            assert at not in drawn
            drawn[at] = p["flag"]
    assert drawn == {at: x for at, x in cells.items() if x} and len(found) < len(drawn) / 2
    page = "".join(reports.drawing(found))
    assert page.count("<rect") == len(found) - 1 and page.count("<svg") == page.count("</svg>") == 2 and "A &amp; B" in page and "Other" not in page


def test_error_and_hidden_groups(result):
    group = of_depot(result, "error_group").collect()
    assert [(g["error"], g["region"], g["count"], g["sample_cells"], g["area_type"]) for g in group] == [("#DIV/0!", "K7:K10", 1, ["K9"], "final output")]
    assert rows(of_depot(result, "hidden_group"), "count", "sheets") == [(1, ["tmp_workings"])]


def test_sheet_and_file_facts(result):
    fact = {r["name"]: r for r in of_depot(result, "sheet_fact").collect()}
    assert fact["Plan calc"]["category"] == "Calculation" and "Output" in fact["Plan calc"]["roles"] and fact["Plan calc"]["information"] == "final output"
    assert fact["Settings"]["category"] == "Input" and fact["Settings"]["read_by"] == ["Plan calc"]
    assert fact["tmp_workings"]["place"] == 5 and fact["tmp_workings"]["visibility"] == "Hidden"
    file = of_depot(result, "file_fact").first()
    assert (file["complexity"], file["formulas"], file["n_sheets"], file["hidden_count"], file["logic_type"], file["reconciliations"]) == ("Low", counted(depot_sheets())[1], 5, 1, "Calculation", 0)
    assert file["source_systems"] == ["Ledger"] and file["preparers"] == ["A. Author"] and file["external_files"] == ["Fleet list v3.xlsx"]


def test_comparison_and_findings(result):
    pair = result["pair"].collect()
    assert len(pair) == 1 and pair[0]["overall"] >= 0.9
    assert rows(result["estate"], "relationship") in ([("Duplicate",)], [("Overlapping logic",)])
    assert sorted(rows(result["cluster"], "size")) == [(1,), (1,), (2,), (2,)]
    found = {r["category"]: r for r in result["finding"].where("category in ('Coverage', 'Hidden sheets')").collect()}
    assert found["Coverage"]["affected"] == 1 and found["Hidden sheets"]["affected"] == 2


def test_narratives_hold_no_values_and_survive_failures(result, tables):
    def boom(bundle):
        raise RuntimeError("down")

    out = portfolio.narratives(result["sheet_fact"], boom).collect()
    assert all(r["basis"] == "drafted: offline fallback" for r in out)
    text = " ".join(r["purpose"] for r in out)
    assert "SKU-0002" not in text and STOCK[3] in text


def test_resume_takes_changed_files_only(spark, folder, tables, tmp_path):
    write_estate(tmp_path)
    first = portfolio.scan(spark, str(tmp_path))["workbook"]
    (tmp_path / "rates.xlsx").write_bytes((folder / "depot.xlsx").read_bytes())
    again = portfolio.scan(spark, str(tmp_path), previous=first)
    assert sorted(rows(again["workbook"], "file_name")) == [("broken.xlsx",), ("rates.xlsx",)]


def test_exports(result, folder, tmp_path):
    files = sinks.export_all(result, str(tmp_path / "out"))
    assert [f.name for f in files] == ["file_summary.csv", "worksheet_details.csv", "portfolio_findings.csv", "diagnostics.csv", "portfolio_review.xlsx"]
    table = list(csv.DictReader(io.StringIO(files[0].read_bytes().decode("utf-8-sig"))))
    broken = next(r for r in table if r["file_name"] == "broken.xlsx")
    assert broken["complexity"] == sinks.NOT_ASSESSED and broken["scan_error"].startswith("not_ooxml: ")
    assert len(list(csv.DictReader(io.StringIO(files[1].read_bytes().decode("utf-8-sig"))))) == 11
    package = workbook.Package(files[4].read_bytes())
    assert [s[1] for s in package.sheets] == ["file summary", "worksheet details", "portfolio findings", "diagnostics"]
    sinks.write_page(tmp_path / "p.html", "A <b> title", {"diagnostics": sinks.export_tables(result)["diagnostics"]})
    page = (tmp_path / "p.html").read_text()
    assert "A &lt;b&gt; title" in page and "#DIV/0!" in page
    sha = result["workbook"].where("file_name = 'depot.xlsx'").first()["sha256"]
    source = {"depot.xlsx": (str(folder / "depot.xlsx"), sha)}
    sinks.bundle(str(tmp_path / "b.zip"), source, {"findings": result["finding"]})
    assert sorted(zipfile.ZipFile(tmp_path / "b.zip").namelist()) == ["analysis/findings.csv", "originals/depot.xlsx"]
    with pytest.raises(ValueError, match="has changed"):
        sinks.bundle(str(tmp_path / "c.zip"), {"depot.xlsx": (str(folder / "depot.xlsx"), "0" * 64)}, {})


def test_fields_have_a_basis(result):
    from gridloom.plans.fields import FILE_FIELDS, TAB_FIELDS

    file = {r["field"]: r for r in of_depot(result, "file_field").collect()}
    assert list(FILE_FIELDS) == [r["field"] for r in sorted(file.values(), key=lambda r: r["place"])]
    assert {r["basis"] for r in file.values()} == {"extracted", "derived", "drafted", "compared", "ask"}
    assert all(r["value"] is None and r["evidence"] for k, r in file.items() if r["basis"] == "ask" and k not in ("potential_retirement", "manual_intervention"))
    assert file["complexity"]["value"] == "Low" and file["complexity"]["confidence"] > 0.5 and any(x.startswith(f"cells: {counted(depot_sheets())[0]}") for x in file["complexity"]["evidence"])
    assert file["potential_duplication"]["value"].startswith("duplicate of: copy of depot.xlsm") and file["potential_duplication"]["evidence"] == ["compared with 3 other file(s) only"]
    assert "Fleet list v3.xlsx" in file["key_inputs"]["value"] and file["potential_retirement"]["value"] == "not established" and file["preparer"]["value"] == "A. Author"
    tab = [r for r in of_depot(result, "tab_field").collect() if r["name"] == "Plan calc"]
    assert {r["field"] for r in tab} == set(TAB_FIELDS) and next(r for r in tab if r["field"] == "category")["value"] == "Calculation"
    assert rows(result["rationalisation"], "kind", "items") == [("duplication", 1)]
    claims = of_depot(result, "evidence").where("field = 'Key inputs'").limit(1).collect()
    assert claims


def test_truncated_sheets_and_modules(spark, folder):
    files = workbook.hashed(workbook.discover(spark, str(folder))).where("path like '%/depot.xlsx'")
    out = portfolio.tables_of(files, max_rows=20)
    book = out["workbook"].first()
    assert book["parse_status"] == "partial" and any("rows from 21 on" in w for w in book["warnings"])
    assert {s["name"] for s in book["sheets"] if s["truncated"]} == {"Stock data", "Plan calc"} and out["cell"].agg(F.max("row")).first()[0] == 20
    # a compound file of 512-byte sectors: header, table, directory
    entry = lambda name, kind, left, right, child: (name.encode("utf-16-le").ljust(64, b"\0") + (2 * len(name) + 2).to_bytes(2, "little") + bytes([kind, 1]) + b"".join(x.to_bytes(4, "little") for x in (left, right, child))).ljust(128, b"\0")
    no = 0xFFFFFFFF
    names = [entry("Root Entry", 5, no, no, 1), entry("VBA", 1, no, no, 2), entry("Module1", 2, 3, 4, no), entry("dir", 2, no, no, no), entry("ThisWorkbook", 2, no, 5, no), entry("_VBA_PROJECT", 2, no, no, no), entry("PROJECT", 2, no, no, no), bytes(128)]
    head = bytearray(512)
    head[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    head[30:32] = (9).to_bytes(2, "little")
    head[48:52] = (1).to_bytes(4, "little")
    head[76:512] = (0).to_bytes(4, "little") + b"\xff" * 432
    table = b"".join(x.to_bytes(4, "little") for x in (0xFFFFFFFD, 2, 0xFFFFFFFE)).ljust(512, b"\xff")
    assert workbook.module_names(bytes(head) + table + b"".join(names)) == ["Module1", "ThisWorkbook"]
    assert workbook.module_names(b"junk") == [] and workbook.module_names(bytes(head)) == []


def test_command_line(spark, tmp_path, capsys):
    from gridloom.__main__ import main

    (tmp_path / "in").mkdir()
    write_estate(tmp_path / "in")
    run = str(tmp_path / "run")
    assert main(["scan", str(tmp_path / "in"), "-o", run]) == 0
    assert (tmp_path / "run" / "review" / "file_summary.csv").exists()
    (tmp_path / "in" / "rates.xlsx").unlink()
    assert main(["scan", str(tmp_path / "in"), "-o", run, "--resume"]) == 0
    capsys.readouterr()
    assert main(["find", run, "depot", "--status", "full"]) == 0
    assert capsys.readouterr().out.count('"file_name"') == 1 + ("copy of depot" in "copy of depot")
    assert main(["report", run, "depot.xlsx", "-o", str(tmp_path / "one.html"), "--format", "html"]) == 0 and (tmp_path / "one.html").stat().st_size > 1000
    assert main(["export", run, "workbook"]) == 0
    assert "rates.xlsx" not in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["report", run, "nothing.xlsx", "-o", "x"])


def test_endpoints_and_reports(spark, result, tmp_path):
    from gridloom.plans import endpoints

    assert tuple(endpoints.overview(result).first()) == (4, 3, 2, 2)
    assert rows(endpoints.files(result, "DEPOT", "full", 1, 5), "file_name") == [("depot.xlsx",)]
    assert endpoints.files(result, "100%").count() == 0
    pk = [r["file_pk"] for r in endpoints.files(result, "depot").collect()]
    assert endpoints.compare(result, pk).count() == 1
    with pytest.raises(ValueError, match="at most 20"):
        endpoints.compare(result, list(map(str, range(21))))
    reports.write_file_report(result, pk[1], str(tmp_path / "one.xlsx"))
    assert len(workbook.Package((tmp_path / "one.xlsx").read_bytes()).sheets) == 13
    reports.write_file_page(result, pk[1], str(tmp_path / "one.html"))
    assert "stockList" not in (tmp_path / "one.html").read_text() and "SKU-0002" not in (tmp_path / "one.html").read_text() and (tmp_path / "one.html").read_text().count("<svg") == 5
    assert [f.stat().st_size > 0 for f in reports.write_estate(result, str(tmp_path))] == [True] * 3
    endpoints.views(result, "gl_")
    assert spark.sql("select count(*) n from gl_sheet_fact where state <> 'visible'").first()["n"] == 2
    assert reports.shown({"verdict": "Yes", "matches": [{"file": "x.xlsx"}]}) == "Yes — matches: x.xlsx"
    assert [reports.shown(x) for x in (None, True, ["a", "b"], [])] == ["—", "Yes", "a; b", "—"]
