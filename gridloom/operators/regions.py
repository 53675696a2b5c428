"""Region detection: islands in rows, rectangles, components, headers and kinds.

Populated cells become runs per row, equal runs on near rows become rectangles, and
rectangles that touch become components.  Columns and rows are compared by equality of
blocks and a residual test, so no step compares all runs of a sheet with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.graph import connected
from gridloom.storage import spool

ROW_BLOCK = 32


def row_runs(cells: DataFrame, keys: list[str], col_gap: int = 0) -> DataFrame:
    """keys, row, c1, c2, n: stretches of populated cells in a row with gaps of at most ``col_gap``."""
    own = Window.partitionBy(*keys, "row").orderBy("col")
    opens = F.when(F.col("col") - F.lag("col").over(own) - 1 <= col_gap, 0).otherwise(1)
    marked = cells.select(*keys, "row", "col").distinct().withColumn("gl_open", opens)
    marked = marked.withColumn("gl_run", F.sum("gl_open").over(own))
    return marked.groupBy(*keys, "row", "gl_run").agg(F.min("col").alias("c1"), F.max("col").alias("c2"), F.count("*").alias("n")).drop("gl_run")


def rectangles(runs: DataFrame, keys: list[str], row_gap: int = 1) -> DataFrame:
    """keys, r1, r2, c1, c2, n: runs of equal columns on near rows, joined."""
    own = Window.partitionBy(*keys, "c1", "c2").orderBy("row")
    opens = F.when(F.col("row") - F.lag("row").over(own) - 1 <= row_gap, 0).otherwise(1)
    marked = runs.withColumn("gl_open", opens).withColumn("gl_box", F.sum("gl_open").over(own))
    return marked.groupBy(*keys, "c1", "c2", "gl_box").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.sum("n").alias("n")).drop("gl_box")


def plates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, flag, r1, r2, c1, c2, n: cells (row, col, flag) as rectangles of one flag without gaps, to be drawn one by one.

    Runs of a row are joined to those right below that have the same columns; a null flag is no cell.
    """
    of = [*keys, "flag"]
    return rectangles(row_runs(cells.where("flag is not null"), of), of, 0)


def components(cells: DataFrame, keys: list[str], row_gap: int = 1, col_gap: int = 0) -> DataFrame:
    """keys, top, left, bottom, right, n_cells: bounding boxes of cells that hang together.

    Runs on rows at most ``row_gap`` apart hang together if their columns overlap (widened by ``col_gap``).
    """
    boxes = rectangles(row_runs(cells, keys, col_gap), keys, row_gap)
    # written down, so that the numbers stay
    boxes = spool(boxes.withColumn("id", F.monotonically_increasing_id()))
    reach = row_gap + 1
    block = lambda r: F.floor(r / ROW_BLOCK)
    laid = boxes.withColumn("gl_block", F.explode(F.sequence(block(F.col("r1")), block(F.col("r2") + reach))))
    a, b = laid.alias("a"), laid.alias("b")
    same = F.lit(True)
    for k in [*keys, "gl_block"]:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    near = (F.col("b.r1") - F.col("a.r2") <= reach) & (F.col("a.r1") - F.col("b.r2") <= reach)
    over = (F.col("a.c1") - col_gap <= F.col("b.c2") + col_gap) & (F.col("b.c1") - col_gap <= F.col("a.c2") + col_gap)
    edges = a.join(b, same & (F.col("a.id") < F.col("b.id")) & near & over).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    label = connected(edges)
    named = boxes.join(label, boxes["id"] == label["node"], "left").withColumn("gl_component", F.coalesce("component", "id"))
    return named.groupBy(*keys, "gl_component").agg(F.min("r1").alias("top"), F.min("c1").alias("left"), F.max("r2").alias("bottom"), F.max("c2").alias("right"), F.sum("n").alias("n_cells")).drop("gl_component")


def pre_shape(boxes: DataFrame) -> DataFrame:
    """Adds shape: title or notes for a single text cell, key_value for label and value columns, else null.

    boxes: n_cells, top, bottom, left, right, text (of a single cell), only_text, left_text, left_distinct, n_left, n_right.
    """
    one = (F.col("n_cells") == 1) & F.col("only_text")
    paired = F.try_divide(F.col("n_right"), F.col("n_left"))
    narrow = (F.col("right") - F.col("left") == 1) & (F.col("bottom") - F.col("top") < 30) & (F.col("n_left") > 0) & (F.col("n_right") > 0)
    pairs = narrow & (F.col("left_text") > 0.8) & (F.col("left_distinct") > 0.9) & paired.between(0.6, 1.0)
    shape = F.when(one, F.when(F.length("text") > 50, "notes").otherwise("title")).when((F.col("n_cells") > 1) & pairs, "key_value")
    return boxes.withColumn("shape", shape)


def header_score() -> Column:
    """Score of a row as header, from its profile and the means of the body."""
    lead = lambda own, body: F.greatest(F.lit(0.0), F.col(own) - F.col(body))
    raw = 0.40 * lead("text_ratio", "body_text") + 0.25 * lead("styled", "body_style") + 0.20 * F.col("distinct") + 0.15 * F.col("density")
    return raw * (1.0 - 0.8 * F.col("formula_ratio"))


def header_rows(profiles: DataFrame, keys: list[str], threshold: float = 0.15, first: str = "top") -> DataFrame:
    """The best header row of each region among four from the row ``first`` on, null below the threshold, and its score."""
    candidate = (F.col("row") - F.col(first)).between(0, 3)
    scored = profiles.where(candidate).withColumn("score", header_score())
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("row")).alias("up"))).alias("best"))
    found = F.col("best.score") >= threshold
    return best.select(*keys, F.when(found, -F.col("best.up")).alias("header_row"), F.round("best.score", 6).alias("score"))


def region_kind() -> Column:
    """Kind of a region by ordered rules, from its aggregates."""
    wide, tall = F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1
    share = F.col("formula_cells") / F.greatest(F.lit(1), F.col("n_cells"))
    heads = F.col("n_header_rows") > 0
    return (
        F.when(F.col("origin") == "listobject", "data_table")
        .when((wide <= 2) & (F.col("mean_length") > 40), "notes")
        .when((wide <= 3) & (tall <= 25) & ~heads & (F.col("left_text") > 0.7), "key_value")
        .when(share > 0.55, "calculation")
        .when(F.col("n_header_rows") > 1, "matrix")
        .when(heads & (F.col("n_data_rows") >= 2), "data_table")
        .otherwise("unknown")
    )


#: Labels of totals rows: a fixed value.
TOTALS = r"(?i)^\s*(grand\s+)?(total|totals|subtotal|sub-total|sum|net|balance)\b"


def totals_row(label, sums, cells) -> Column:
    """Is a region's last row one of totals: by its label, or by SUM in half of its cells?"""
    return F.coalesce(label.rlike(TOTALS), F.lit(False)) | (sums >= F.greatest(F.lit(1), F.floor(cells / 2)))


def adjusted_confidence(confidence, density, headers, data_rows, columns, clean) -> Column:
    """Confidence after the fact: less for sparse regions, more where columns are of one type."""
    sparse = F.when(density < 0.5, confidence * 0.75).otherwise(confidence)
    part = F.coalesce(F.try_divide(clean, columns), F.lit(0.0))
    return F.round(F.when(headers & (data_rows >= 3) & (part >= 0.8), F.least(F.lit(1.0), sparse + 0.15 * part)).otherwise(sparse), 2)
