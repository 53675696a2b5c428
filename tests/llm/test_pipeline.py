"""The pipeline, stage by stage, against plain versions; and the queries' registration."""

import re

import corpus_pipeline
from conftest import SMALL
from gridloom.llm import common, quality, secrets
from gridloom.llm import queries as llm_queries
from gridloom.llm import sql as llm_sql
from pyspark.sql import functions as F
from test_sets import WORDS, brute_near, brute_targets
from test_text_scans import brute_contamination


def test_stages_and_run(spark, docs):
    source = docs[0]
    rows = {r["doc_id"]: r for r in source.collect()}
    kept = {r["doc_id"] for r in quality.report(source).where("kept").collect()}
    unique = set(brute_near([(d, rows[d]["text"]) for d in sorted(kept)]))
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {d for d in unique if not brute_contamination(rows[d]["text"], items)[4]}
    wanted = {d: secrets.redacted(rows[d]["text"], [x for part in secrets.scan_text(rows[d]["text"]) for x in part]) for d in clean}
    start = common.mark()
    out = corpus_pipeline.run(spark, SMALL)
    assert common.mark() == start + 1  # the result is all that is left
    assert out.columns == [*source.columns, "copy"]
    got = out.collect()
    assert {r["doc_id"] for r in got} <= clean and all(r["text"] == wanted[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert not any(re.search(r"(?i)token = \"[0-9a-f]{24}", r["text"]) for r in got)
    size = {d: len(WORDS.findall(t)) for d, t in wanted.items()}
    by, taken, longest = {}, {}, {}
    for d, n in size.items():
        s = rows[d]["source"]
        by[s], longest[s] = by.get(s, 0) + n, max(longest.get(s, 0), n)
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    target = brute_targets(by)
    assert all(abs(taken.get(s, 0) - target[s]) <= longest[s] + 1 for s in by)
    assert sorted((r["doc_id"], r["copy"]) for r in got) == sorted({(r["doc_id"], r["copy"]) for r in got})


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for df in (odd[0], empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL)
            assert out.columns == [*df.columns, *(["copy"] if name == "mixing" else [])]
            df = common.spool(out)


def test_stages_keep_columns_with_names_of_their_own(spark, odd):
    extra = ["gl_result", "gl_row", "GL_group", "copy", "node", "root", "row", "key", "fp", "a.b", "size", "word"]
    df = odd[0].select("*", *(F.lit(f"mine {x}").alias(x) for x in extra))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SMALL)
        assert out.columns == [*df.columns, *(["copy_1"] if name == "mixing" else [])], name
        rows = out.collect()
        assert rows and all(r[x] == f"mine {x}" for r in rows for x in extra), name


def test_registration():
    names = llm_queries.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10
    assert set(llm_sql.oracle_sql()) <= set(names)


def test_spool_can_be_cleared(spark):
    import os

    df = common.spool(spark.range(3))
    folder = common.shared_folder(spark).removeprefix("file://") + "/gridloom-spool"
    assert df.count() == 3 and os.path.isdir(folder)
    common.clear_spool(spark)
    assert not os.path.exists(folder)


def test_only_texts_that_may_go_are_moved(spark, monkeypatch):
    """Rows that are not among the ids looked for stay where they are, but for few that share their bits; none of the ids is lost."""
    from gridloom.llm import neardup

    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id) as text")
    gone = spark.range(0, 20_000, 100).selectExpr("id as gl_gone")
    may, rest = neardup.parted(docs, "doc_id", gone)
    # the one shuffle is that of the bits
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "SortMergeJoin" not in plan
    assert may.columns == rest.columns == docs.columns
    held = {r["doc_id"] for r in may.collect()}
    assert set(range(0, 20_000, 100)) <= held and len(held) < 250 and rest.count() == 20_000 - len(held)
    # with few bits most are looked up, and the result is the same
    for bits in (64, 1 << 26):
        monkeypatch.setattr(neardup, "BITS", bits)
        assert {r["doc_id"] for r in neardup.without(docs, "doc_id", gone).collect()} == {i for i in range(20_000) if i % 100}
    empty = neardup.without(docs, "doc_id", gone.where("gl_gone < 0"))
    assert empty.count() == 20_000


def test_near_duplicates_join_no_whole_table_of_texts(spark, docs):
    """The stage's last step moves ids and texts that may go, not every text to meet the ids that stay."""
    from gridloom.llm import neardup

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = neardup.deduplicated(docs[0])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" not in text and "Union" in text
