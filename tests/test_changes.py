"""Folders followed as they change: state by path, replays, and the tables of what is there now."""

import os

from gridloom.plans import portfolio
from gridloom.sinks.xlsx import Sheet, write
from gridloom.streaming import changes
from pyspark.sql import functions as F


def book(path, value, at):
    write(path, [Sheet("Rates", [["Name", "Rate"], ["a", value], ["b", 2]])])
    os.utime(path, (at, at))


def seen(spark, out, number=None):
    rows = spark.read.parquet(f"{out}/change").collect()
    return sorted((r["path"].rpartition("/")[2], r["change"]) for r in rows if number is None or r["batch"] == number)


def files(t):
    return sorted(r["file_name"] for r in t["workbook"].collect())


def test_change_delete_touch_and_replay(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("a", "b", "c"):
        book(source / f"{name}.xlsx", ord(name), 1_700_000_000)
    changes.watch(spark, str(source), out)
    assert seen(spark, out) == [("a.xlsx", "new"), ("b.xlsx", "new"), ("c.xlsx", "new")]
    # one changes, one goes, one is only touched, one comes
    book(source / "a.xlsx", 7, 1_700_000_100)
    (source / "b.xlsx").unlink()
    os.utime(source / "c.xlsx", (1_700_000_200,) * 2)
    book(source / "d.xlsx", 4, 1_700_000_300)
    changes.watch(spark, str(source), out)
    assert seen(spark, out, 1) == [("a.xlsx", "changed"), ("b.xlsx", "gone"), ("d.xlsx", "new")]
    now = changes.current(spark, out)
    assert files(now) == ["a.xlsx", "c.xlsx", "d.xlsx"]
    assert now["cell"].where("row = 2 and col = 2").agg(F.sort_array(F.collect_list("value"))).first()[0] == ["4", "7", "99"]
    # the whole log again: nothing is a change
    spark.read.schema(changes.EVENT).parquet(f"{out}/event").coalesce(1).write.parquet(str(tmp_path / "again"))
    for part in (tmp_path / "again").glob("*.parquet"):
        part.rename(f"{out}/event/again-{part.name}")
    before = len(seen(spark, out))
    changes.watch(spark, str(source), out)
    assert len(seen(spark, out)) == before and files(changes.current(spark, out)) == files(now)
    # one that went comes back as it was, beside a copy of another: files of one content share a key, and its cells are there once
    book(source / "b.xlsx", ord("b"), 1_700_000_000)
    (source / "e.xlsx").write_bytes((source / "d.xlsx").read_bytes())
    changes.watch(spark, str(source), out)
    last = max(r["batch"] for r in spark.read.parquet(f"{out}/change").collect())
    assert seen(spark, out, last) == [("b.xlsx", "new"), ("e.xlsx", "new")]
    fresh, now = portfolio.scan(spark, str(source)), changes.current(spark, out)
    for name in ("workbook", "cell", "region"):
        assert sorted(map(str, now[name].select(fresh[name].columns).collect())) == sorted(map(str, fresh[name].collect()))
