"""What assessors get and what of their answers holds."""

import json

from gridloom.operators import bundles
from pyspark.sql import functions as F

TABS = "file string, name string, headers array<string>, candidates array<struct<source_a: string, source_b: string, cues: array<string>>>"


def accepted(spark, answer, tabs):
    answers = spark.createDataFrame([("f", answer if isinstance(answer, str) or answer is None else json.dumps(answer))], "file string, answer string")
    return [r.asDict() for r in bundles.reconciliations(answers, spark.createDataFrame([("f", *t) for t in tabs], TABS)).orderBy("place").collect()]


def claim(sheet="Check", a="Ledger", b="Bank", cited=("Ledger", "Bank", "Variance"), **more):
    return {"worksheet": sheet, "source_a": a, "source_b": b, "evidence": [{"worksheet": sheet, "text": t} for t in cited]} | more


def test_reconciliation_claims(spark):
    tabs = [("Check", ["Ledger", "Bank", " Variance ", "Account", None, ""], [("Hub", "Spoke", ["agreed total"])]), ("Recon 2", ["Left", "Right"], None), ("Plain", ["Left", "Right"], [])]
    good = accepted(spark, {"reconciliations": [
        claim(matching_criteria="ACCOUNT", tolerance="1 %"), claim("check ", " LEDGER", "bank"), claim("Nowhere"), claim(b="ledger"), claim(b="Cash"), claim(cited=("Ledger", "Variance")), claim(cited=("Ledger", "Bank")),
        claim(a="Hub", b="Spoke", cited=("Hub", "Spoke", "AGREED total", "made up")), claim("Recon 2", "Left", "Right", ("Left", "Right")), claim("Plain", "Left", "Right", ("Left", "Right")), None, {"worksheet": "Check"}, {"worksheet": 5, "evidence": "none"},
    ]}, tabs)
    assert [(r["place"], r["worksheet"], r["overview"], r["evidence"]) for r in good] == [(1, "Check", "Ledger against Bank", ["Ledger", "Bank", "Variance"]), (2, "Check", "Hub against Spoke", ["Hub", "Spoke", "AGREED total"]), (3, "Recon 2", "Left against Right", ["Left", "Right"])]
    assert (good[0]["matching_criteria"], good[0]["tolerance"]) == ("ACCOUNT", "not in the file's evidence")
    for none in ("", "no JSON", "[]", '{"reconciliations": "x"}', '{"reconciliations": []}', None):
        assert accepted(spark, none, tabs) == []
    # a citation of another sheet counts for nothing
    moved = claim() | {"evidence": [{"worksheet": "Plain", "text": t} for t in ("Ledger", "Bank", "Variance")]}
    assert accepted(spark, {"reconciliations": [moved]}, tabs) == []


def test_bundles_and_narratives(spark):
    files = spark.createDataFrame([("f", "Depot.xlsx", "Low"), ("g", "Empty.xlsx", "Low")], "file string, file_name string, complexity string")
    rows = [("f", 2, "Plan", ["Month", "In", "Month", " ", None], "Calculation", "final output", True), ("f", 1, "Data", [f"H{i}" for i in range(150)], "Input", "data input", False)]
    bundle = bundles.bundles(files, spark.createDataFrame(rows, "file string, place int, name string, headers array<string>, category string, information string, hidden boolean")).cache()
    got = {r["file"]: r["bundle"] for r in bundle.collect()}
    assert [t["name"] for t in got["f"]["tabs"]] == ["Data", "Plan"] and len(got["f"]["tabs"][0]["headers"]) == 100 and got["f"]["tabs"][1]["headers"] == ["Month", "In"]
    assert got["f"]["business_evidence"][:2] == ["Data", "H0"] and len(got["f"]["business_evidence"]) == 154 and got["g"]["tabs"] == [] and got["g"]["sheet_count"] == 0

    def told(answer):
        answers = spark.createDataFrame([] if answer is None else [("f", answer if isinstance(answer, str) else json.dumps(answer))], "file string, answer string")
        return {(r["field"], r["sheet"]): (r["text"], r["basis"]) for r in bundles.narrated(bundle, answers).where("file = 'f'").collect()}

    offline = told(None)
    assert len(offline) == 6 and {b for _, b in offline.values()} == {"drafted"}
    assert offline["sheet_purpose", "Plan"][0] == "Calculation sheet, final output: Month, In (hidden)" and offline["purpose", None][0].startswith("not established")
    some = told({"purpose": " Plans trucks. ", "outcome": "", "process": ["x"], "sub_process": 7, "tabs": {"DATA": "Raw rows.", "Nowhere": "x", "Plan": None}})
    assert some["purpose", None] == ("Plans trucks.", "inferred") and some["sub_process", None] == ("7", "inferred") and some["sheet_purpose", "Data"] == ("Raw rows.", "inferred")
    fallen = "drafted: offline fallback"
    assert [some[k][1] for k in (("outcome", None), ("process", None), ("sheet_purpose", "Plan"))] == [fallen] * 3
    for broken in ("", "no JSON", "[1]", '{"purpose": '):
        assert {b for _, b in told(broken).values()} == {fallen}
    assert told({"tabs": {"data": "first", "DATA": "second"}})["sheet_purpose", "Data"][0] == "first"


def test_bundles_of_an_assessment(spark, tmp_path):
    from books import STOCK, write_estate
    from gridloom.plans import portfolio

    write_estate(tmp_path)
    t = portfolio.assess(portfolio.scan(spark, str(tmp_path)))
    row = t["bundle"].where("bundle.file_name = 'depot.xlsx'").first()
    b = row["bundle"]
    assert b["sheet_count"] == 5 and b["complexity"] == "Low" and [x["name"] for x in b["tabs"]][:2] == ["Settings", "Stock data"] and b["tabs"][1]["headers"][:5] == STOCK and b["tabs"][0]["downstream"] == ["Plan calc"]
    text = json.dumps(row.asDict(recursive=True))
    assert "SKU-0002" not in text and STOCK[3] in text and b["tabs"][-1]["hidden"]
    answers = spark.createDataFrame([(row["file"], json.dumps({"purpose": "Plans pallets.", "tabs": {"Plan calc": "Counts pallets."}}))], "file string, answer string")
    said = {(r["field"], r["sheet"]): r["text"] for r in portfolio.narration(t, answers).where(F.col("file") == row["file"]).collect()}
    assert said["purpose", None] == "Plans pallets." and said["sheet_purpose", "Plan calc"] == "Counts pallets." and len(said) == 9
    assert portfolio.reconciliation_claims(t, answers).count() == 0
    edge = portfolio.precedent_edges(t).where(F.col("file") == row["file"])
    total = edge.where("sheet = 'Plan calc' and row = 15 and col = 3").collect()
    assert sorted((e["top"], e["left"], e["bottom"], e["right"], e["form"]) for e in total) == [(6, 3, 10, 3, "range"), (12, 3, 14, 3, "range")]
    assert portfolio.error_impact(t).count() == 0
