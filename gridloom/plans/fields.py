"""The fields of files and sheets, from the tables of an assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import scalars as S
from gridloom.operators import fields as of
from gridloom.operators import rules
from gridloom.operators import similarity as sim

Tables = dict[str, DataFrame]
FILE_FIELDS = (
    "file_id", "complexity", "key_inputs", "source_system", "preparer", "key_outputs", "purpose", "outcome", "process", "sub_process", "usage_frequency", "completion_timeline", "output_recipient",
    "potential_duplication", "similar_files", "potential_consolidation", "potential_simplification", "potential_automation", "potential_retirement",
    "logic_type", "logic_types", "business_area", "key_calculations", "manual_intervention", "macros", "external_links", "reconciliation",
)
TAB_FIELDS = ("visibility", "category", "roles", "information", "area_type", "purpose", "calculation", "upstream", "mapping_tables", "downstream", "reconciliation", "validation")
PEERS = 5


def inputs(t: Tables) -> DataFrame:
    """file, source_type, source_name, n, position: what a file takes in from elsewhere."""
    book = t["workbook"].select(F.col("file_pk").alias("file"), "external_links", "connections", "pivot_sources")

    def part(kind: str, column: str, label) -> DataFrame:
        each = book.select("file", F.posexplode(column).alias("position", "x"))
        return each.select("file", F.lit(kind).alias("source_type"), label(F.col("x")).alias("source_name"), F.lit(1).alias("n"), "position")

    links = part("External workbook", "external_links", S.external_name)
    formal = part("Data connection", "connections", lambda x: S.connection_label(F.coalesce(x["name"], F.lit("")), F.coalesce(x["type"], F.lit(""))))
    pivots = part("Pivot source", "pivot_sources", lambda x: F.when(x.rlike(S.SENSITIVE), "unnamed connection").otherwise(x))
    return links.unionByName(formal).unionByName(pivots).where("source_name is not null")


def reviews(t: Tables) -> DataFrame:
    """kind, file_a, file_b: pairs to look at together, by what could be done about them; see rollups.rationalisation."""
    kind = S.ordered((F.col("relationship") == "Duplicate", "duplication"), (F.col("relationship").isin("Overlapping logic", "Same output, different method", "Shared source"), "consolidation"))
    return t["estate"].select(kind.alias("kind"), F.col("a").alias("file_a"), F.col("b").alias("file_b")).where("kind is not null")


def _texts(rows: DataFrame, file: str, text: Column, order: list, label: str, k: int | None = None) -> DataFrame:
    """file_pk and the rows' texts in order, the first k."""
    place = F.row_number().over(Window.partitionBy(file).orderBy(*order))
    laid = rows.select(F.col(file).alias("file_pk"), text.alias("text"), place.alias("place"))
    laid = laid if k is None else laid.where(F.col("place") <= k)
    return laid.groupBy("file_pk").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias(label))


def file_fields(t: Tables) -> DataFrame:
    """One row a field of every file."""
    f, book = t["file_fact"], t["workbook"].select("file_pk", "sha256", "vba_modules", F.size("external_links").alias("n_links")).dropDuplicates(["file_pk"])
    names = f.select("file_pk", "file_name").dropDuplicates(["file_pk"])
    pairs = sim.both_ways(t["pair"]).join(names.select(F.col("file_pk").alias("peer"), "file_name"), "peer")
    links = sim.both_ways(t["estate"]).join(names.select(F.col("file_pk").alias("peer"), "file_name"), "peer")
    best = [F.desc("overall"), "file_name", "peer"]
    shown = F.concat(F.col("file_name"), F.lit(" ("), F.format_number("overall", 3), F.lit(")"))
    taken = F.concat(F.col("source_name"), F.lit(" ["), F.col("source_type"), F.lit(", "), F.col("business_purpose"), F.lit("]"))
    todo = F.concat(F.col("name"), F.lit(": "), F.col("proposed_change"))
    parts = [
        _texts(t["key_input"], "file", taken, ["source_type", "source_name"], "taken"),
        _texts(t["deliverable"], "file", F.col("name"), ["name"], "outputs"),
        _texts(t["simplification"], "file", todo, ["name", "issue"], "simpler"),
        _texts(t["automation"], "file", F.col("name"), ["name"], "manual"),
        _texts(pairs, "file", shown, best, "similar", PEERS),
        _texts(links.where("relationship = 'Duplicate'"), "file", shown, best, "duplicates", PEERS),
        _texts(links.where("relationship in ('Overlapping logic', 'Same output, different method', 'Shared source')"), "file", F.concat(F.col("file_name"), F.lit(": "), F.col("relationship")), best, "joint", PEERS),
        _texts(t["narrative"].where("position = 0"), "file_pk", F.col("purpose"), ["position"], "story", 1),
    ]
    out = f.join(book, "file_pk", "left")
    for p in parts:
        out = out.join(p, "file_pk", "left")
    others = names.count() - 1
    note = F.array_compact(F.array(rules.corpus_note(F.lit(others))))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    verdict = lambda c, yes, no: F.when(n(c) > 0, F.concat(F.lit(f"{yes}: "), F.array_join(c, "; "))).otherwise(no)
    made = {
        "file_id": of.extracted(F.substring("sha256", 1, 12), "start of the content's hash"),
        "complexity": of.derived(F.col("complexity"), F.col("confidence"), F.col("evidence")),
        "key_inputs": of.derived(of.listed(F.col("taken")), 0.8, ("links, connections and pivot sources of the package",)),
        "source_system": of.derived(of.listed(F.col("source_systems")), 0.7, ("names of data connections",)),
        "preparer": of.extracted(of.listed(F.col("preparers")), "document properties"),
        "key_outputs": of.derived(of.listed(F.col("outputs")), 0.6, ("output sheets that are named like reports",)),
        "purpose": of.drafted(F.get("story", F.lit(0)), F.lit("first sheet")),
        "outcome": of.ask("Which decision or figure depends on this file?"),
        "process": of.ask("Which process does this file belong to?"),
        "sub_process": of.ask("Which step of the process does it serve?"),
        "usage_frequency": of.ask("How often is it used?"),
        "completion_timeline": of.ask("By when must it be ready?"),
        "output_recipient": of.ask("Who gets its results?"),
        "potential_duplication": of.compared(verdict("duplicates", "duplicate of", "none found"), note),
        "similar_files": of.compared(of.listed(F.col("similar")), note),
        "potential_consolidation": of.compared(verdict("joint", "see together with", "none found"), note),
        "potential_simplification": of.derived(of.listed(F.col("simpler")), 0.6, ("counts of constants, volatile functions and shapes; a person must confirm",)),
        "potential_automation": of.derived(verdict("manual", "manual steps may be in", "none found"), 0.5, ("labels that speak of manual work; a person must confirm",)),
        "potential_retirement": of.field(F.lit("not established"), "ask", None, tuple(rules.RETIREMENT)),
        "logic_type": of.derived(F.col("logic_type"), F.col("logic_confidence"), ("functions called",)),
        "logic_types": of.derived(of.listed(F.col("logic_types")), F.col("logic_confidence"), ("functions called and roles of sheets",)),
        "business_area": of.derived(F.col("business_area"), F.col("logic_confidence"), ("activities",)),
        "key_calculations": of.derived(of.listed(F.array_distinct("key_calculations")), 0.6, ("headers, functions and roles",)),
        "manual_intervention": of.field(of.listed(F.col("manual")), "ask", None, ("Which figures are keyed or pasted, and by whom?",)),
        "macros": of.extracted(F.when(F.col("has_vba"), F.concat(F.lit("yes"), F.when(n("vba_modules") > 0, F.concat(F.lit(": "), F.array_join("vba_modules", ", "))).otherwise(""))).otherwise("no"), "package parts"),
        "external_links": of.extracted(of.listed(F.array_distinct("external_files")), "relations of the package"),
        "reconciliation": of.derived(F.when(F.col("reconciliations") > 0, F.concat(F.col("reconciliations").cast("string"), F.lit(" to confirm"))).otherwise("none found"), 0.5, ("regions whose headers name two sources and a comparison",)),
    }
    wide = out.select("file_pk", "file_name", "parse_status", *(made[k].alias(k) for k in FILE_FIELDS))
    return of.long_table(wide, ["file_pk", "file_name", "parse_status"], list(FILE_FIELDS))


def tab_fields(t: Tables) -> DataFrame:
    """One row a field of every sheet."""
    up = t["upstream"].select(F.col("file").alias("file_pk"), "name", F.col("sheets").alias("up"), "mapping_tables")
    down = t["downstream"].select(F.col("file").alias("file_pk"), "name", F.transform("consumers", lambda x: F.concat(x["sheet"], F.lit(" ("), x["role"], F.lit(")"))).alias("down"))
    story = t["narrative"].select("file_pk", "position", F.col("purpose").alias("story"), F.col("basis").alias("story_basis"))
    s = t["sheet_fact"].drop("purpose").join(up, ["file_pk", "name"], "left").join(down, ["file_pk", "name"], "left").join(story, ["file_pk", "position"], "left")
    why = F.concat(F.array(F.concat(F.lit("formulas per cell: "), F.format_number(rules.ratio(), 2))), F.transform("kinds", lambda k: F.concat(F.lit("region: "), k)))
    found = F.transform("reconciliations", lambda r: F.concat(r["source_a"], F.lit(" and "), r["source_b"], F.lit(" by "), r["matching_criteria"]))
    made = {
        "visibility": of.extracted(F.col("visibility"), "sheet state"),
        "category": of.derived(F.col("category"), F.col("confidence"), why),
        "roles": of.derived(of.listed(F.col("roles")), F.col("confidence"), why),
        "information": of.derived(F.col("information"), 0.6, ("roles, formulas and references",)),
        "area_type": of.derived(F.col("area_type"), 0.6, ("roles",)),
        "purpose": of.drafted(F.col("story"), F.col("story_basis")),
        "calculation": of.derived(F.col("description"), 0.6, ("headers, functions and roles",)),
        "upstream": of.extracted(of.listed(F.col("up")), "references in formulas"),
        "mapping_tables": of.extracted(of.listed(F.col("mapping_tables")), "references in formulas"),
        "downstream": of.extracted(of.listed(F.col("down")), "references in formulas of other sheets"),
        "reconciliation": of.derived(of.listed(found), 0.5, ("headers of one region",)),
        "validation": of.field(F.when(F.size("validation_reasons") > 0, F.concat(F.lit("yes: "), F.array_join("validation_reasons", "; "))).otherwise("no"), "derived", 0.7, F.concat(rules.questions(F.col("validation_reasons")), F.transform("manual_labels", lambda x: F.concat(F.lit("label: "), x)))),
    }
    wide = s.select("file_pk", "position", "name", "place", *(made[k].alias(f"x_{k}") for k in TAB_FIELDS))
    wide = wide.select("file_pk", "position", "name", F.col("place").alias("shown_at"), *(F.col(f"x_{k}").alias(k) for k in TAB_FIELDS))
    return of.long_table(wide, ["file_pk", "position", "name", "shown_at"], list(TAB_FIELDS))
