"""From a folder of workbooks to tables: scan, assess, compare, findings.

    tables = scan(spark, "/data/workbooks")
    result = assess(tables)
    write_portfolio(result, "/out")

Each step maps tables to tables; nothing is gathered on the driver before the sinks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import formulas as fx
from gridloom.functions import scalars as S
from gridloom.operators import bundles, detect, evidence, graph, joins, precedents, profiles, rollups, rules
from gridloom.operators import similarity as sim
from gridloom.plans import fields
from gridloom.sources import workbook
from gridloom.storage import delete, spool

Tables = dict[str, DataFrame]
KEYS = detect.KEYS
TOP_SHAPES, TOP_FUNCTIONS = 15, 12


def scan(spark: SparkSession, path: str, max_rows: int = workbook.MAX_ROWS, previous: DataFrame | None = None) -> Tables:
    """workbook, sheet, cell, formula, region and occupancy tables of all workbook files below a path.

    previous: the workbook table of an earlier run; files unchanged since (same path, size and hash, not failed) are left
    out, told by their hashes alone.
    """
    files = workbook.hashed(workbook.discover(spark, path))
    if previous is not None:
        files = unseen(files, previous)
    return tables_of(files, max_rows)


def unseen(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Files that are new, changed, or failed before. files: path, length, sha; previous: path, size_bytes, sha256, parse_status."""
    known = previous.select("path", F.col("size_bytes").alias("length"), F.col("sha256").alias("sha"), (F.col("parse_status") == "failed").alias("gl_failed"))
    todo = joins.changed(files.select("path", "length", "sha"), known, "path", ["length", "sha"], "gl_failed")
    return files.join(spool(todo.select("path")), "path", "left_semi")


def tables_of(files: DataFrame, max_rows: int = workbook.MAX_ROWS) -> Tables:
    """The tables of files given as path, content and sha; every file is opened once."""
    with workbook.small_batches(files.sparkSession):
        found = spool(workbook.read(files, max_rows))
    book = spool(workbook.books(found))
    cell = spool(workbook.cells(found).dropDuplicates([*KEYS, "row", "col"]))
    sheet = spool(book.select("file_pk", F.explode("sheets").alias("s")).select("file_pk", "s.*").dropDuplicates(KEYS))
    formula = spool(formula_table(cell))
    shown = profiles.occupancy(cell.withColumn("is_formula", F.col("formula").isNotNull()), KEYS)
    return {"workbook": book, "sheet": sheet, "cell": cell, "formula": formula, "region": spool(detect.detect(cell, sheet)), "occupancy": shown}


def run(spark: SparkSession, path: str, max_rows: int = workbook.MAX_ROWS, before: Tables | None = None) -> Tables:
    """Scan and assess; with the tables of an earlier run, only what has changed is scanned and the rest is taken from there."""
    if before is None:
        return assess(scan(spark, path, max_rows))
    fresh = scan(spark, path, max_rows, before["workbook"])
    here = workbook.discover(spark, path).select("path")
    stays = spool(before["workbook"].join(here, "path", "left_semi").join(fresh["workbook"].select("path"), "path", "left_anti"))
    keys = stays.select("file_pk").distinct()
    merged = {"workbook": spool(stays.unionByName(fresh["workbook"], allowMissingColumns=True))}
    for name in ("sheet", "cell", "formula", "region", "occupancy"):
        old = joins.still_there(before[name], keys, "file_pk").join(fresh["workbook"].select("file_pk"), "file_pk", "left_anti")
        merged[name] = spool(old.unionByName(fresh[name], allowMissingColumns=True))
    return assess(merged)


def save(result: Tables, folder: str) -> None:
    """The tables of a run as Parquet below its folder; those of an earlier run are replaced only when all new ones are written."""
    spark = result["workbook"].sparkSession
    for name, df in result.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables.new/{name}")
    delete(spark, f"{folder}/tables")
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(f"{folder}/tables.new"), path(f"{folder}/tables"))


def formula_table(cell: DataFrame) -> DataFrame:
    """The formulas of the cell table, normalised."""
    own = cell.where("formula is not null").select(*KEYS, "sheet", "row", "col", "formula")
    a = fx.analysed(F.col("formula"), F.col("row").cast("long"), F.col("col").cast("long"))
    return own.withColumn("a", a).select(*KEYS, "sheet", "row", "col", "formula", "a.*").drop("precedents")


def sheet_facts(t: Tables) -> DataFrame:
    """One row a sheet: counts, shapes, dependencies, kinds and headers; then category, roles and information."""
    f = t["formula"].select("*", (F.col("cross_sheet_refs") > 0).alias("is_cross"), (F.col("external_refs") > 0).alias("is_external"))
    profile = profiles.formula_profile(f, KEYS)
    called = f.select(*KEYS, F.explode("functions").alias("fn"), F.struct("row", "col").alias("at"))
    top = profiles.top_items(called, KEYS, "fn", "at", TOP_FUNCTIONS)
    calls = lambda names, label: F.coalesce(F.sum(F.when(F.col("fn").isin(list(names)), F.col("n"))), F.lit(0)).alias(label)
    by_kind = top.groupBy(*KEYS).agg(calls(rules.LOOKUPS + ("LOOKUP",), "lookup"), calls(rules.CONDITIONS, "conditional"), calls(rules.AGGREGATES, "aggregate"), calls(rules.TEXTS, "textual"))
    counts = t["cell"].groupBy(*KEYS).agg(F.count("*").alias("populated"), F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.count_if("is_error").alias("n_errors"))
    counts = counts.withColumn("density", F.round(F.col("populated") / (F.col("max_row").cast("long") * F.col("max_col")), 3))
    region = t["region"].groupBy(*KEYS).agg(F.collect_set("kind").alias("kinds"), F.filter(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("region_id", "headers"))), lambda x: x["headers"])), lambda h: h != "").alias("headers"), F.collect_list("headers").alias("region_headers"))
    names = t["sheet"].select("file_pk", "position", "name", "state")
    by_name = names.select(F.col("file_pk").alias("file"), "name")
    edge = edges(t)
    degree = graph.degrees(edge, by_name).withColumnRenamed("file", "file_pk")
    pivots = t["workbook"].select("file_pk", (F.size("pivot_sources") > 0).alias("has_pivots"))
    zero = ["populated", "max_row", "max_col", "n_errors", "lookup", "conditional", "aggregate", "textual", "total", "distinct_skeletons", "volatile_count", "cross_sheet_count", "external_count", "hardcoded_literal_count", "compression"]
    out = names
    for part in (counts, profile, by_kind, region):
        out = out.join(part, KEYS, "left")
    out = out.fillna(0, zero).join(degree, ["file_pk", "name"], "left").join(pivots.distinct(), "file_pk", "left")
    none = F.array().cast("array<string>")
    out = out.select("*", F.col("file_pk").alias("file"), F.col("total").alias("formulas"), F.col("hardcoded_literal_count").alias("literals"), F.col("volatile_count").alias("volatile"))
    out = out.withColumns({"kinds": F.coalesce("kinds", none), "headers": F.coalesce("headers", none), "visibility": S.visibility(F.col("state"))})
    out = rules.assessed_sheets(out)
    # one candidate a region
    found = F.coalesce(F.array_compact(F.transform("region_headers", lambda h: rules.reconciliation(F.col("name"), h))), F.array().cast("array<struct<source_a:string,source_b:string,matching_criteria:string,cues:array<string>>>"))
    out = out.withColumn("reconciliations", found).withColumn("description", rules.calculation_description(out))
    out = out.withColumn("validation_reasons", rules.validation_triggers()).withColumn("manual_labels", rules.manual_evidence(F.col("name"), F.col("headers")))
    return rules.visible_first(out.withColumn("review_required", F.size("validation_reasons") > 0))


def precedent_edges(t: Tables) -> DataFrame:
    """What every formula reads: one row a formula and area; see operators.precedents."""
    return precedents.edges(t["formula"].select(F.col("file_pk").alias("file"), "sheet", "row", "col", "formula"))


def error_impact(t: Tables) -> DataFrame:
    """Formulas that depend on a cached error, and by how many steps."""
    bad = t["cell"].where("is_error").select(F.col("file_pk").alias("file"), "sheet", "row", "col")
    return precedents.affected(precedent_edges(t), bad)


def edges(t: Tables) -> DataFrame:
    """Dependencies between the sheets of a file: file, src, dst, n."""
    used = t["formula"].select(F.col("file_pk").alias("file"), F.col("sheet").alias("src"), F.explode("referenced_sheets").alias("dst")).groupBy("file", "src", "dst").agg(F.count("*").alias("n"))
    return graph.sheet_edges(used, t["sheet"].select(F.col("file_pk").alias("file"), "name"))


def error_groups(t: Tables, facts: DataFrame) -> DataFrame:
    """Cached errors by sheet, type and region, with area, downstream outputs and what to do."""
    bad = t["cell"].where("is_error").select(*KEYS, "sheet", "row", "col", F.col("text").alias("error"))
    placed = joins.cell_regions(bad, t["region"].select(*KEYS, "region_id", "top", "left", "bottom", "right", "ref"), KEYS, ["region_id"])
    own = F.concat(S.column_letters(F.col("col")), F.col("row").cast("string"))
    box = F.col("box")
    named = placed.select(*KEYS, "sheet", "error", "row", "col", own.alias("cell"), F.coalesce(S.range_ref(box["top"], box["left"], box["bottom"], box["right"]), own).alias("region"))
    keys = [*KEYS, "sheet", "error", "region"]
    groups = rollups.error_groups(named, keys, ["row", "col"], "cell")
    role = facts.select(*KEYS, "area_type", "read_by")
    outputs = facts.where(F.array_contains(F.array_union("roles", F.array("category")), "Output")).groupBy("file_pk").agg(F.collect_set("name").alias("outputs"))
    out = groups.join(role, KEYS, "left").join(outputs, "file_pk", "left")
    downstream = F.array_sort(F.array_intersect("read_by", F.coalesce("outputs", F.array().cast("array<string>"))))
    downstream = F.when((F.size(downstream) == 0) & (F.col("area_type") == "final output"), F.array("sheet")).otherwise(downstream)
    broken = F.col("error") == "#REF!"
    action = F.when(broken, "Repair the broken reference; recalculating does not fix it.").otherwise("Refresh sources and recalculate; then see whether the errors remain.")
    return out.select(*keys, "count", "sample_cells", "area_type", downstream.alias("downstream_outputs"), (~broken).alias("recalc_required"), action.alias("reviewer_action"))


def hidden_groups(facts: DataFrame) -> DataFrame:
    """Hidden sheets of each file by purpose."""
    hidden = facts.where("state <> 'visible'")
    purpose = rollups.hidden_purpose(F.col("name"), F.array_union("roles", F.array("category")), F.col("populated"), F.col("formulas"))
    return rollups.hidden_groups(hidden.select("file_pk", purpose.alias("purpose"), "name", F.col("read_by").alias("readers")), ["file_pk", "purpose"])


def file_facts(t: Tables, facts: DataFrame) -> DataFrame:
    """One row a file: totals, complexity, activities, preparer, sources, and counts of findings."""
    shape = facts.select("file_pk", F.col("populated").alias("cells"), "formulas", "distinct_skeletons", F.col("cross_sheet_count").alias("cross_sheet"), F.col("literals").alias("hardcoded"), "volatile")
    totals = profiles.totals(shape, "file_pk").drop("n_sheets")
    agg = facts.groupBy("file_pk").agg(
        F.count("*").alias("n_sheets"), F.count_if(F.col("state") != "visible").alias("hidden_count"), F.sum("n_errors").alias("cached_errors"), F.count_if("review_required").alias("review_count"),
        *(F.sum(c).alias(c) for c in ("lookup", "aggregate", "textual")), F.array_distinct(F.flatten(F.collect_set(F.array_union("roles", F.array("category"))))).alias("sheet_roles"),
        F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("position", "description"))), lambda x: x["description"])).alias("key_calculations"), F.sum(F.size("reconciliations")).alias("reconciliations"),
    )
    safe = F.filter(F.transform("connections", lambda c: F.trim(c["name"])), lambda n: n.isNotNull() & (n != "") & ~n.rlike(S.SENSITIVE))
    book = t["workbook"].select(
        "file_pk", "path", "file_name", "parse_status", S.scan_error(F.col("error_category"), S.redacted_message(F.col("scan_error"), F.col("path"))).alias("scan_error"), "has_vba", "has_power_query",
        (F.size("external_links") + F.size("connections")).alias("links"), F.size("pivot_sources").alias("n_pivots"), F.array_sort(F.array_distinct(safe)).alias("source_systems"),
        F.array_sort(F.array_distinct(F.array_compact(F.array("creator", "last_modified_by")))).alias("preparers"), F.transform("external_links", S.external_name).alias("external_files"),
    )
    zero = ["cells", "formulas", "distinct_skeletons", "cross_sheet", "hardcoded", "volatile", "non_formula_cells", "n_sheets", "hidden_count", "cached_errors", "review_count", "lookup", "aggregate", "textual", "reconciliations"]
    out = book.join(totals, "file_pk", "left").join(agg, "file_pk", "left").fillna(0, zero)
    out = out.withColumn("sheet_roles", F.coalesce("sheet_roles", F.array().cast("array<string>")))
    return rules.logic_types(profiles.complexity(out))


def fingerprints(t: Tables, facts: DataFrame) -> DataFrame:
    """Tokens of each file: skeleton, function, header, sheet, input and output signals."""
    at = F.struct("row", "col")
    shapes = profiles.top_items(t["formula"].select(*KEYS, "skeleton", at.alias("at")), KEYS, "skeleton", "at", TOP_SHAPES)
    called = profiles.top_items(t["formula"].select(*KEYS, F.explode("functions").alias("fn"), at.alias("at")), KEYS, "fn", "at", TOP_FUNCTIONS)
    of = lambda df, signal, token: df.select(F.col("file_pk").alias("file"), F.lit(signal).alias("signal"), token.alias("token"))
    heads = lambda df, signal, filtered: of(df.select("file_pk", F.explode(S.header_tokens(F.col("headers"), filtered)).alias("h")), signal, F.col("h"))
    inputs = facts.where((F.col("category") == "Input") | (F.col("information") == "data input"))
    book = t["workbook"]
    external = book.select("file_pk", F.explode("external_links").alias("x"))
    parts = [
        of(shapes, "skeleton", F.col("skeleton")), of(called, "function", F.col("fn")), heads(facts, "header", False), of(facts, "sheet", F.lower(F.trim("name"))),
        heads(inputs, "input", True), heads(facts.where("category = 'Output'"), "output", True), of(external, "input", F.concat(F.lit("ext:"), F.lower("x"))),
        of(book.select("file_pk", F.explode("connections").alias("c")).where("coalesce(c.name, c.type) is not null"), "input", F.concat(F.lit("conn:"), F.lower(F.coalesce("c.name", "c.type")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def topology(facts: DataFrame, edge: DataFrame) -> DataFrame:
    """Sheets per category and edges of each file."""
    count = lambda c: F.count_if(F.col("category") == c).alias(c.replace(" ", "_"))
    n = edge.groupBy("file").agg(F.count("*").alias("edges"))
    return facts.groupBy(F.col("file_pk").alias("file")).agg(*map(count, rules.CATEGORIES)).join(n, "file", "left").fillna(0, ["edges"])


#: What to do about findings of a category.
ACTIONS = {
    "Cached errors": "refresh and recalculate, repair what stays",
    "Hidden sheets": "find out who needs them",
    "Comparison": "confirm the purpose of both files",
    "Human validation": "assign the sheets to reviewers",
    "Opportunities": "confirm with the owners",
    "Coverage": "mend the files and resume the run",
}


def findings(t: Tables, ids: list[str] | None = None) -> DataFrame:
    """All roll-ups in one table, over all files or those chosen."""
    chosen = lambda df, *keys: df if ids is None else df.where(reduce(lambda a, b: a & b, (F.col(k).isin(ids) for k in keys)))
    files, errors, hidden = (chosen(t[k], "file_pk") for k in ("file_fact", "error_group", "hidden_group"))
    text = lambda *x: F.concat_ws(" ", *(v if not isinstance(v, str) else F.lit(v) for v in x))
    review = F.lit("Review")
    e = rollups.error_rollup(errors, "error", "area_type", "file_pk", "count")
    h = hidden.groupBy("purpose").agg(F.count_distinct("file_pk").alias("f"), F.sum("count").alias("n"))
    p = rollups.pair_rollup(chosen(t["estate"], "a", "b").select(F.col("a").alias("file_a"), F.col("b").alias("file_b"), "relationship"))
    r = files.where("review_count > 0").agg(F.count("*").alias("f"), F.coalesce(F.sum("review_count"), F.lit(0)).alias("n")).where("f > 0")
    c = files.where("parse_status = 'failed'").agg(F.count("*").alias("n")).where("n > 0")
    some = lambda name: chosen(t[name], "file").agg(F.count_distinct("file").alias("f"), F.count("*").alias("n")).where("n > 0")
    out = rollups.findings(
        [
            rollups.finding(e, "Cached errors", text(F.col("error_type"), "in", F.col("area_type")), F.col("severity"), F.col("files"), F.col("cells")),
            rollups.finding(h, "Hidden sheets", text("Hidden", F.lower("purpose"), "tabs"), review, F.col("f"), F.col("n")),
            rollups.finding(p, "Comparison", F.col("relationship"), review, F.col("files"), F.col("pairs")),
            rollups.finding(r, "Human validation", F.lit("Sheets for a reviewer"), review, F.col("f"), F.col("n")),
            rollups.finding(some("simplification"), "Opportunities", F.lit("Simplification"), review, F.col("f"), F.col("n")),
            rollups.finding(some("automation"), "Opportunities", F.lit("Manual work"), review, F.col("f"), F.col("n")),
            rollups.finding(c, "Coverage", F.lit("Files that could not be read"), F.lit("High"), F.col("n"), F.col("n")),
        ]
    )
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("category"))
    action = F.when(F.col("finding").startswith("#REF!"), "repair the references: recalculating does not").otherwise(action)
    why = F.concat(F.col("affected").cast("string"), F.lit(" in "), F.col("files").cast("string"), F.lit(" file(s)"))
    return out.select(F.lit("all files" if ids is None else "chosen files").alias("scope"), "*", action.alias("action"), why.alias("evidence"))


Assessor = Callable[[dict], dict]


def offline(bundle: dict) -> dict:
    """A narrative from the evidence alone: what a sheet is, by its category and headers."""
    heads = ", ".join(bundle["headers"][:5])
    return {"purpose": f"{bundle['category']} tab '{bundle['name']}'" + (f" with {heads}." if heads else "."), "basis": "drafted"}


def narratives(facts: DataFrame, assessor: Assessor = offline) -> DataFrame:
    """file_pk, position, purpose, basis: any callable from value-free evidence to text; its failures fall back to the offline one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                bundle = {"name": r.name, "category": r.category, "roles": list(r.roles), "information": r.information, "headers": list(r.headers)[:100]}
                try:
                    found = assessor(bundle)
                except Exception:  # noqa: BLE001
                    found = offline(bundle) | {"basis": "drafted: offline fallback"}
                rows.append((r.file_pk, r.position, str(found["purpose"]), str(found["basis"])))
            yield pd.DataFrame(rows, columns=["file_pk", "position", "purpose", "basis"])

    return facts.select("file_pk", "position", "name", "category", "roles", "information", "headers").mapInPandas(run, "file_pk string, position int, purpose string, basis string")


def file_bundles(t: Tables) -> DataFrame:
    """file and bundle: the evidence of every file for an assessor, without cell values; see operators.bundles."""
    wide = t["file_field"].where(F.col("field").isin("complexity", "logic_type", "logic_types", "business_area", "key_calculations", "key_inputs", "reconciliation")).groupBy(F.col("file_pk").alias("file"), "file_name")
    files = wide.pivot("field", ["complexity", "logic_type", "logic_types", "business_area", "key_calculations", "key_inputs", "reconciliation"]).agg(F.first("value"))
    up = t["upstream"].select("file", "name", F.col("sheets").alias("upstream"))
    down = t["downstream"].select("file", "name", F.transform("consumers", lambda x: x["sheet"]).alias("downstream"))
    own = t["sheet_fact"].select(F.col("file_pk").alias("file"), "place", "name", "headers", "visibility", "category", "roles", "information", "description", (F.col("state") != "visible").alias("hidden"))
    return bundles.bundles(files, own.join(up, ["file", "name"], "left").join(down, ["file", "name"], "left"))


def narration(t: Tables, answers: DataFrame) -> DataFrame:
    """What answers (file, answer: JSON text) say of files and sheets, with the basis of each text; see operators.bundles."""
    return bundles.narrated(t["bundle"], answers)


def reconciliation_claims(t: Tables, answers: DataFrame) -> DataFrame:
    """The reconciliations that answers (file, answer: JSON text) claim, as far as the files' own headers support them."""
    tabs = t["sheet_fact"].select(F.col("file_pk").alias("file"), "name", "headers", F.transform("reconciliations", lambda r: F.struct(r["source_a"].alias("source_a"), r["source_b"].alias("source_b"), r["cues"].alias("cues"))).alias("candidates"))
    return bundles.reconciliations(answers, tabs)


def assess(t: Tables, assessor: Assessor = offline) -> Tables:
    """Tables of the assessment: sheet_fact, file_fact, error_group, hidden_group, pair, estate, cluster, family, finding, narrative and more."""
    facts = spool(sheet_facts(t))
    files = spool(file_facts(t, facts))
    errors, hidden = spool(error_groups(t, facts)), spool(hidden_groups(facts))
    tokens, edge = spool(fingerprints(t, facts)), spool(edges(t))
    pairs = spool(sim.offered(*sim.similar_classes(tokens)))
    estate = spool(sim.estate_pairs(tokens, topology(facts, edge)))
    cluster = spool(sim.clusters(estate, files.select(F.col("file_pk").alias("file")).distinct()))
    out = t | {
        "sheet_fact": facts, "file_fact": files, "error_group": errors, "hidden_group": hidden, "token": tokens, "edge": edge, "pair": pairs, "estate": estate, "cluster": cluster,
        "family": sim.families(estate, cluster, tokens), "narrative": spool(narratives(facts, assessor)),
        "simplification": rules.simplification(facts), "automation": rules.automation(facts), "deliverable": rules.deliverables(facts), "upstream": rules.upstream(edge, facts), "downstream": rules.downstream(edge, facts),
    }
    out["key_input"] = spool(rules.key_inputs(fields.inputs(t)))
    out["rationalisation"] = rollups.rationalisation(fields.reviews(out))
    out["finding"] = findings(out)
    out["file_field"], out["tab_field"] = spool(fields.file_fields(out)), spool(fields.tab_fields(out))
    out["evidence"], out["bundle"] = evidence_table(out), file_bundles(out)
    return out


def evidence_table(t: Tables) -> DataFrame:
    """entity, field, text: what claims about files can cite."""
    named = F.create_map(*[F.lit(x) for kv in {"purpose": "Purpose of file", "key_inputs": "Key inputs", "key_outputs": "Key outputs", "key_calculations": "Key calculations / logic", "manual_intervention": "Manual intervention"}.items() for x in kv])
    known = t["file_field"].where("value is not null").withColumn("label", F.try_element_at(named, F.col("field"))).where("label is not null")
    return known.select(F.col("file_pk").alias("entity"), F.col("label").alias("field"), F.explode(F.split("value", "; ")).alias("text")).where("trim(text) <> ''")


def accepted_claims(t: Tables, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """The claims of an assessor that hold: every citation is checked against the files' own fields; see operators.evidence."""
    return evidence.accepted(claims, citations, t["evidence"])
