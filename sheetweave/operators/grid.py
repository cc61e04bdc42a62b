"""The cell grid: delivery, bounding boxes, merged ranges, dense grids, simple tables and HTML.

Cells are rows (file_id, sheet_idx, row_idx, col_idx, value, formula, ...), sparse as read. Every operator is keyed by
(file_id, sheet_idx), aggregates partially before it shuffles, and assembles text in two steps (cells to rows, rows to parts
of a sheet), so that no group is larger than a bounded part, whatever the share of one sheet in all cells.

Defined results: sheets without values have no bounding box row; null values render as empty cells; repeated deliveries of a
coordinate count once (the latest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.cells import border_css, css, header_name, is_formula, json_value, td
from sheetweave.functions.coords import coord_name

SHEET = ["file_id", "sheet_idx"]
HEAD = "<table border='1' style=\"border-collapse: collapse; min-width: 100%;\">"


def delivered(cells: DataFrame) -> DataFrame:
    """Each coordinate once, as last delivered; ties on the arrival go to the highest cell id."""
    value = [c for c in cells.columns if c not in ("file_id", "sheet_idx", "coord", "loaded_at", "cell_id")]
    best = F.max_by(F.struct("cell_id", "loaded_at", *value), F.struct("loaded_at", "cell_id"))
    return cells.groupBy("file_id", "sheet_idx", "coord").agg(best.alias("b")).select("file_id", "sheet_idx", "coord", "b.*")


def bounding_box(cells: DataFrame, merges: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """file_id, sheet_idx, min_row, max_row, min_col, max_col over values, formulas, merged ranges and image anchors."""
    used = cells.filter(F.col("value").isNotNull() | is_formula(F.col("formula"))).select(*SHEET, F.col("row_idx").alias("r"), F.col("col_idx").alias("c"))
    if merges is not None:
        used = used.unionByName(merges.select(*SHEET, F.col("max_row").alias("r"), F.col("max_col").alias("c")))
    if anchors is not None:
        used = used.unionByName(anchors.filter("row_idx is not null and col_idx is not null").select(*SHEET, F.col("row_idx").alias("r"), F.col("col_idx").alias("c")))
    return used.groupBy(*SHEET).agg(F.lit(1).alias("min_row"), F.max("r").alias("max_row"), F.lit(1).alias("min_col"), F.max("c").alias("max_col"))


def merged_cells(merges: DataFrame) -> DataFrame:
    """A row per cell of each merged range: spans on the top left one (``is_anchor``), nothing on the rest."""
    df = merges.withColumn("row_idx", F.explode(F.sequence("min_row", "max_row"))).withColumn("col_idx", F.explode(F.sequence("min_col", "max_col")))
    anchor = (F.col("row_idx") == F.col("min_row")) & (F.col("col_idx") == F.col("min_col"))
    return df.select(*SHEET, "row_idx", "col_idx", anchor.alias("is_anchor"), F.when(anchor, F.col("max_col") - F.col("min_col") + 1).alias("colspan"), F.when(anchor, F.col("max_row") - F.col("min_row") + 1).alias("rowspan"))


def ranges_of(cells: DataFrame) -> DataFrame:
    """Merged ranges that the spans of the cells tell of."""
    s = cells.filter("coalesce(colspan, 1) > 1 or coalesce(rowspan, 1) > 1")
    return s.select(*SHEET, F.col("row_idx").alias("min_row"), (F.col("row_idx") + F.coalesce("rowspan", F.lit(1)) - 1).alias("max_row"), F.col("col_idx").alias("min_col"), (F.col("col_idx") + F.coalesce("colspan", F.lit(1)) - 1).alias("max_col"))


def dense(cells: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Every visible cell of the bounding box, empty ones too; cells covered by a merged range are left out."""
    box = bounding_box(cells, ranges_of(cells), anchors)
    grid = box.select(*SHEET, F.explode(F.sequence(F.lit(1), "max_row")).alias("row_idx"), "max_col").select(*SHEET, "row_idx", F.explode(F.sequence(F.lit(1), "max_col")).alias("col_idx"))
    covered = merged_cells(ranges_of(cells)).filter("not is_anchor")
    own = cells.select(*SHEET, "row_idx", "col_idx", "value", "formula", "unit", "style", "colspan", "rowspan")
    shown = grid.join(covered, [*SHEET, "row_idx", "col_idx"], "left_anti").join(own, [*SHEET, "row_idx", "col_idx"], "left")
    return shown.withColumn("coord", coord_name(F.col("row_idx"), F.col("col_idx")))


def style_of(style: Column, members: list[str]) -> Column:
    """CSS of a cell's style struct: fill and slant where it has them, borders, weight."""
    if {"fill", "italic"} <= set(members):
        return css(style["fill"], style["borders"], style["bold"], style["italic"])
    edge = border_css(style["borders"])
    return F.concat_ws("; ", F.when(edge != "", edge), F.when(style["bold"], F.lit("font-weight: bold")))


def html_tables(cells: DataFrame, rows_per_part: int | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """file_id, sheet_idx, part_no, html: the sheet as an HTML table, its rows in order, empty cells and rows kept.

    With ``rows_per_part`` a longer sheet comes in parts (from 0) that join to the table, so that no group is unbounded.
    With ``anchors`` the table reaches to the images too.
    """
    box = bounding_box(cells, ranges_of(cells), anchors)
    d = dense(cells, anchors).select(*SHEET, "row_idx", "col_idx", td(F.col("coord"), F.col("value"), F.col("colspan"), F.col("rowspan"), style_of(F.col("style"), cells.schema["style"].dataType.names), F.col("formula"), F.col("unit")).alias("td"))
    every = box.select(*SHEET, F.explode(F.sequence(F.lit(1), "max_row")).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("").alias("td"))
    rows = d.unionByName(every).groupBy(*SHEET, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "td"))).alias("t"))
    rows = rows.select(*SHEET, "row_idx", F.concat(F.lit("  <tr>"), F.array_join(F.col("t.td"), ""), F.lit("</tr>")).alias("tr"))
    part = F.floor((F.col("row_idx") - 1) / rows_per_part).cast("int") if rows_per_part else F.lit(0)
    parts = rows.groupBy(*SHEET, part.alias("part_no")).agg(F.array_sort(F.collect_list(F.struct("row_idx", "tr"))).alias("t"), F.max("row_idx").alias("_last"))
    parts = parts.join(box.select(*SHEET, "max_row"), SHEET)
    head = F.when(F.col("part_no") == 0, HEAD + "\n").otherwise("")
    tail = F.when(F.col("_last") == F.col("max_row"), "\n</table>").otherwise("\n")
    return parts.select(*SHEET, "part_no", F.concat(head, F.array_join(F.col("t.tr"), "\n"), tail).alias("html"))


def simple_sheets(cells: DataFrame) -> DataFrame:
    """Sheets that are plain tables: no merged ranges, two rows or more, two headers or more."""
    a = cells.groupBy(*SHEET).agg(
        F.max(F.when(F.col("value").isNotNull(), F.col("row_idx"))).alias("rows"),
        F.count_if((F.col("row_idx") == 1) & F.col("value").isNotNull()).alias("heads"),
        F.count_if((F.coalesce("colspan", F.lit(1)) > 1) | (F.coalesce("rowspan", F.lit(1)) > 1)).alias("merged"),
    )
    return a.select(*SHEET, ((F.col("rows") >= 2) & (F.col("heads") >= 2) & (F.col("merged") == 0)).alias("is_simple")).fillna(False)


def simple_rows(cells: DataFrame) -> DataFrame:
    """Rows of simple tables in long form: file_id, sheet_idx, row_idx, col_idx, header, value, json (of its type); nulls left out.

    Of columns with the same header the last value of a row counts.
    """
    own = cells.join(simple_sheets(cells).filter("is_simple"), SHEET, "left_semi")
    heads = own.filter("row_idx = 1").select(*SHEET, "col_idx", F.col("value").alias("_h"), F.col("value_type").alias("_k"))
    body = own.filter("row_idx > 1 and value is not null").select(*SHEET, "row_idx", "col_idx", "value", json_value(F.col("value"), F.col("value_type")).alias("json")).join(heads, [*SHEET, "col_idx"], "left")
    body = body.withColumn("header", header_name(F.col("_h"), F.col("_k"), F.col("col_idx")))
    last = F.max(F.struct("col_idx", "value", "json")).alias("b")
    return body.groupBy(*SHEET, "row_idx", "header").agg(last).select(*SHEET, "row_idx", "b.col_idx", "header", "b.value", "b.json")
