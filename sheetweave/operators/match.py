"""Text sections matched to the cells and media they speak of.

Every match is keyed by file and sheet, so it is a hash join with a residual condition and never a product of tables. Values
that can't match (null, blank, one digit) and repeats are dropped first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.cells import is_formula, is_aggregate, logic_note
from sheetweave.functions.coords import col_of, in_range, range_name, row_of
from sheetweave.functions.text import strip

KEYS = ["file_id", "sheet_name"]


def value_matches(sections: DataFrame, cells: DataFrame) -> DataFrame:
    """(keys, section_no, coord, formula, unit) of cells whose text occurs in a section, letter case apart."""
    text = strip(F.lower("value"))
    vals = cells.filter(F.col("value").isNotNull()).select(*KEYS, "coord", "formula", "unit", text.alias("_v"))
    vals = vals.filter((F.col("_v") != "") & ~F.col("_v").rlike(r"^\p{Nd}$"))
    body = sections.select(*KEYS, "section_no", F.lower("body").alias("_b"))
    return body.join(vals, KEYS).filter(F.contains("_b", "_v")).select(*KEYS, "section_no", "coord", "formula", "unit")


def section_facts(matches: DataFrame, notes: bool = True) -> DataFrame:
    """Per section: coordinates (range of the matched cells), has_formulas, annotations in cell order."""
    m = matches.withColumn("r", row_of(F.col("coord"))).withColumn("c", col_of(F.col("coord")))
    note = F.when(is_aggregate(F.col("formula")), logic_note(F.col("coord"), F.col("formula"), F.col("unit")))
    g = m.groupBy(*KEYS, "section_no").agg(
        F.min("r").alias("r1"), F.min("c").alias("c1"), F.max("r").alias("r2"), F.max("c").alias("c2"),
        F.bool_or(is_formula(F.col("formula")) & (F.coalesce("coord", F.lit("")) != "")).alias("has_formulas"),
        F.array_sort(F.collect_set(F.when(note.isNotNull(), F.struct("r", "c", note.alias("n"))))).alias("a"),
    )
    text = F.array_join(F.col("a.n"), "\n") if notes else F.lit("")
    return g.select(*KEYS, "section_no", range_name(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2")).alias("coordinates"), "r1", "c1", "r2", "c2", "has_formulas", text.alias("annotations"))


def media_flags(sections: DataFrame, facts: DataFrame, media: DataFrame) -> DataFrame:
    """(keys, section_no) of sections that name a media file or whose range holds one."""
    s = sections.select(*KEYS, "section_no", "body").join(facts.select(*KEYS, "section_no", "r1", "c1", "r2", "c2"), [*KEYS, "section_no"], "left")
    m = media.select(*KEYS, "filename", row_of(F.col("coord")).alias("mr"), col_of(F.col("coord")).alias("mc")).distinct()
    named = (F.coalesce("filename", F.lit("")) != "") & F.contains("body", "filename")
    inside = in_range(F.col("mr"), F.col("mc"), F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2"))
    return s.join(m, KEYS).filter(F.coalesce(named, F.lit(False)) | inside).select(*KEYS, "section_no").distinct()


def associate(rows: DataFrame, media: DataFrame, band: int = 5) -> DataFrame:
    """The one media item of each row: at its coordinate, else in its photo area, else within ``band`` cells in its row or column.

    rows: file_id, row_no, coordinate, area_start, area_end; media: file_id, idx, coord, filename. First in list order in each rule.
    """
    r = rows.withColumn("rr", row_of(F.col("coordinate"))).withColumn("rc", col_of(F.col("coordinate")))
    for n in ("start", "end"):
        r = r.withColumn(f"{n}_r", row_of(F.col(f"area_{n}"))).withColumn(f"{n}_c", col_of(F.col(f"area_{n}")))
    m = media.withColumn("mr", row_of(F.col("coord"))).withColumn("mc", col_of(F.col("coord"))).select("file_id", "idx", "coord", "filename", "mr", "mc")
    exact = F.upper("coordinate") == F.upper("coord")
    area = in_range(F.col("mr"), F.col("mc"), F.col("start_r"), F.col("start_c"), F.col("end_r"), F.col("end_c"))
    near = (F.col("mc") == F.col("rc")) & (F.abs(F.col("mr") - F.col("rr")) <= band) | (F.col("mr") == F.col("rr")) & (F.abs(F.col("mc") - F.col("rc")) <= band)
    rule = F.when(exact, 1).when(area, 2).when(near, 3)
    hits = r.join(m, "file_id").withColumn("rule", rule).filter("rule is not null")
    return hits.groupBy("file_id", "row_no").agg(F.min(F.struct("rule", "idx", "coord", "filename")).alias("b")).select("file_id", "row_no", "b.rule", "b.idx", "b.coord", "b.filename")


def find_coord(values: DataFrame, cells: DataFrame) -> DataFrame:
    """The coordinate of a key's value: a cell equal to it, else one that contains it, else one that contains the key.

    values: file_id, sheet_name, key, value; cells: file_id, sheet_name, row_idx, col_idx, coord, value. First in cell order.
    Equal cells are met by a join on the text; only values without one are held against the texts of their sheet, each once.
    """
    v = values.select(*KEYS, "key", strip(F.col("value")).alias("_v")).distinct()
    c = cells.filter("value is not null").select(*KEYS, "row_idx", "col_idx", "coord", strip(F.col("value")).alias("_c"))
    first = c.groupBy(*KEYS, "_c").agg(F.min(F.struct("row_idx", "col_idx", "coord")).alias("b"))  # a text's first cell
    equal = v.filter("_v <> ''").join(first.withColumnRenamed("_c", "_v"), [*KEYS, "_v"]).select(*KEYS, "key", "_v", F.lit(1).alias("rule"), "b.coord")
    rest = v.join(equal.select(*KEYS, "key", "_v"), [*KEYS, "key", "_v"], "left_anti")
    rule = F.when((F.col("_v") != "") & (F.col("_c") != "") & F.contains("_c", "_v"), 2).when(F.contains("_c", "key"), 3)
    near = rest.join(first, KEYS).withColumn("rule", rule).filter("rule is not null")
    near = near.groupBy(*KEYS, "key", "_v").agg(F.min(F.struct("rule", "b")).alias("m")).select(*KEYS, "key", "_v", "m.rule", "m.b.coord")
    return equal.unionByName(near).select(*KEYS, "key", F.col("_v").alias("value"), "rule", "coord")
