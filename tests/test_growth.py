"""What moves between tasks: counted in plans, where no side is small enough to be broadcast."""

import random
import re

import numpy as np
import pytest

from gridloom.operators import intervals, joins, precedents, tiles
from gridloom.operators import similarity as sim
from gridloom.plans import aggregates, base, books, bundles, gates, sheets, similar
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_files_are_dealt_over_all_tasks(spark):
    # one pair of profiles of 300 files each, in one partition
    sets = spark.createDataFrame([(i % 2, i) for i in range(600)], "rep long, file long").coalesce(1)
    pairs = sim.expanded(spark.createDataFrame([(0, 1, 0.9)], "a long, b long, overall double").coalesce(1), sets)
    assert pairs.count() == 90_000
    sizes = [n for n in pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 1 and max(sizes) < 45_000


def test_tokens_read_line_items_once_for_each_sum(spark, plan):
    assert plan(similar._tokens(spark, SMALL)).count("lineitem.parquet") == 2


def test_reconciliations_move_answers_not_claims(spark, plan):
    assert plan(bundles.reconciliation_gate(spark, SMALL)).count("Exchange ") == 3


def test_row_profile_moves_line_items_once(spark, plan):
    assert plan(aggregates.row_profile(spark, SMALL)).count("Exchange ") == 1


def test_pairs_of_suppliers_read_line_items_once(spark, plan):
    text = plan(aggregates._pairs(spark, SMALL))
    assert text.count("FileScan") == 1 and text.count("Exchange ") == 2


def test_claims_join_customers_once(spark, plan):
    text = plan(gates.accepted_claims(spark, SMALL))
    assert text.count("customer.parquet") == 2 and text.count("orders.parquet") == 3


def test_pairs_that_fail_are_not_moved(spark, monkeypatch):
    """Orders share parts, shelves and suppliers with many others: pairs are decided where they meet."""
    tried = []
    paired = sim.paired
    monkeypatch.setattr(sim, "paired", lambda sets, found: tried.append(found) or paired(sets, found))
    n = sim.similar_pairs(similar._orders(spark, SMALL)).count()
    found = tried[0].collect()
    assert n and len(found) <= 2 * n and len(set(found)) == len(found)


def test_points_meet_boxes_in_tasks_of_bounded_rows(spark, plan):
    """Points and boxes move once each, equal points are one, and tasks grow in number, not in rows."""
    text = plan(aggregates.cell_regions(spark, SMALL))
    assert text.count("Exchange ") == 2 and text.count("lineitem.parquet") == 1
    rows = base.table(spark, SMALL, "lineitem")
    assert base.tasks(rows, 100) == -(-rows.count() // 100) and base.tasks(rows) == 8
    points = spark.createDataFrame([(1, 5, 2), (1, 5, 2), (1, 70, 2), (None, 5, 2)], "s int, row int, col int")
    boxes = spark.createDataFrame([(1, 1, 1, 99, 3, 7), (1, 2, 2, 9, 2, 8)], "s int, top int, left int, bottom int, right int, id int")
    found = lambda **more: sorted(((r["s"], r["row"], r["box"] and r["box"]["id"]) for r in joins.cell_regions(points, boxes, ["s"], ["top", "id"], **more).collect()), key=str)
    assert found(once=3) == [(1, 5, 7), (1, 70, 7), (None, 5, None)]
    assert found() == [(1, 5, 7), (1, 5, 7), (1, 70, 7), (None, 5, None)]


def test_cells_are_never_the_side_that_is_sent_to_every_task(spark):
    text = books.workbook_cells(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in text and "BuildLeft" not in text


def test_plates_move_cells_once(spark, plan):
    assert plan(sheets.occupancy_plates(spark, SMALL)).count("Exchange ") == 1


def test_workbooks_are_made_by_all_tasks(spark):
    made = books._files(spark, SMALL).select("path").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(made) == 25 and sum(n > 0 for n in made) > 4


def test_large_sets_are_compared_in_blocks(spark, monkeypatch):
    """Files whose large sets mostly share tokens: the same pairs, best peers, clusters and families as by candidates, several blocks and copies included."""
    rnd = random.Random(9)
    sets = {f: {s: {f"{i}:{rnd.randrange(3 + (f % 4 == 0))}" for i in range(n)} for s, n in (("skeleton", 12 * (f % 9 > 0)), ("header", 14), ("function", 9), ("sheet", 1), ("input", 12), ("output", 12))} for f in range(150)}
    sets |= {1000 + f: sets[f % 20] for f in range(70)}
    tokens = spark.createDataFrame([(f, s, t) for f, x in sets.items() for s, ts in x.items() for t in ts], "file long, signal string, token string").cache()
    files = tokens.select("file").distinct().union(spark.createDataFrame([(9999,)], "file long")).cache()
    topo = files.select("file", *(F.pmod(F.col("file") * (i + 2), F.lit(3)).alias(f"k{i}") for i in range(7)))
    called = []
    compared = tiles.compared
    monkeypatch.setattr(tiles, "compared", lambda *a: called.append(a) or compared(*a))
    monkeypatch.setattr(tiles, "ROWS", 40)
    monkeypatch.setattr(tiles, "MEMBERS", 2)
    monkeypatch.setattr(tiles, "CELLS", 1 << 9)
    monkeypatch.setattr(tiles, "ENTRIES", 1 << 9)
    monkeypatch.setattr(tiles, "OUT", 7)
    of = {
        "pairs": lambda: sim.similar_pairs(tokens), "classes": lambda: sim.similar_classes(tokens)[0],
        "best": lambda: sim.shortlist(*sim.similar_classes(tokens, best=5), 4), "offered": lambda: sim.offered(*sim.similar_classes(tokens, best=4), 3),
        "estate": lambda: sim.estate_pairs(tokens, topo), "kinds": lambda: sim.estate_classes(tokens, topo)[0],
        "clusters": lambda: sim.estate_clusters(tokens, topo, files), "families": lambda: sim.estate_families(tokens, topo, files),
    }
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    fast = {k: rows(f()) for k, f in of.items()}
    assert len(called) == 9
    monkeypatch.setattr(tiles, "dense", lambda *a: False)
    for k, f in of.items():
        assert rows(f()) == fast[k] and fast[k], k
    assert len(called) == 9


def test_three_places_as_sql_rounds_them():
    x = np.array([0.0625, 0.3125, 0.0005, 0.3495, 0.34949999999999998, 1 / 3, 1.0, 0.0, 0.1235, 0.5 + 1e-9])
    assert tiles.thousandths(x).tolist() == [63, 313, 1, 350, 350, 333, 1000, 0, 124, 500]


def test_rows_that_are_not_there_are_not_cast(spark):
    """A cast of an empty text fails inside, at many times the cost of one that does not, even where it is only tried."""
    df = spark.createDataFrame([(1, "S", 1, 1, "=A1+B:B")], "file long, sheet string, row long, col long, formula string")
    before = re.findall(r"(\S+) try_cast\(", precedents.edges(df)._jdf.queryExecution().optimizedPlan().toString())
    assert before and set(before) == {"THEN"}


def test_short_ranges_take_few_steps(spark):
    """Levels that a range can't fill are not tried, and the blocks are those that all levels give."""
    spans = [(a, a + n - 1) for a in (1, 2, 3, 7, 8, 1000, (1 << 20) - 3) for n in (0, 1, 2, 3, 4, 5, 31, 32, 33, 50, 1 << 20, (1 << 22) + 5)]
    found = spark.createDataFrame(spans, "a long, b long").select("a", "b", intervals.blocks(F.col("a"), F.col("b")).alias("x"))
    assert "bin(" in str(intervals.blocks(F.col("a"), F.col("b")))
    for r in found.collect():
        held = sorted(((q["block"] << q["level"]) + 1, (q["block"] + 1) << q["level"]) for q in r["x"])
        assert sum(y - x + 1 for x, y in held) == r["b"] - r["a"] + 1 and (not held or (held[0][0], held[-1][1]) == (r["a"], r["b"]))
        assert all(x[1] + 1 == y[0] for x, y in zip(held, held[1:], strict=False))
