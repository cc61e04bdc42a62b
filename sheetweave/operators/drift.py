"""Schemas that drift between the files of a template.

Rows are loaded as path-value maps whose raw JSON types are kept (``variant``), path and type statistics are aggregated by
file, consecutive files are compared, and the rows are then projected into one typed table under the last name of each
field, with failed casts reported instead of dropped.

Scale: cells are keyed by (template, sheet, file, row); the comparison joins only cells of gone and new fields, on the row
key, so its output is bounded by changed fields per row. Nothing is collected to the driver and no group of rows is
materialised in one task; only the change list of one sheet of a template is (it has at most one entry per changed field).

Defined results: files without JSON or rows give no cells; repeated deliveries count once; a field that only holds nulls has
no type and never changes it; rows without a whole-number key aren't compared, but counted and projected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetweave.operators.nested import one_delivery, with_nodes
from sheetweave.session import checkpointed

#: The names a row key may have, and the member with child objects.
ROW_KEYS = ("id", "No", "管理番号", "row_key", "Nr")
CHILDREN = "lots"
SCOPE = ["template_id", "sheet_name"]


def _keep(files: DataFrame) -> DataFrame:
    return one_delivery(files.select("file_id", "template_id", "period", "loaded_at", "sheets"), ("template_id", "period"))


def json_type(v: str) -> str:
    """SQL: JSON type of a variant, null for null."""
    return (
        f"case when {v} is null or is_variant_null({v}) then null else case substring_index(schema_of_variant({v}), '<', 1) "
        f"when 'STRING' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end end"
    )


def row_cells(files: DataFrame) -> DataFrame:
    """A row per member of each data row: template_id, sheet_name, period, file_id, pos, row_key, field, jtype, value."""
    rows = with_nodes(_keep(files), keep=("file_id", "template_id", "period")).select("file_id", "template_id", "period", "sheet_name", F.expr("inline(rows)"))
    rows = rows.withColumn("_m", F.expr("try_variant_get(body, '$', 'map<string,variant>')"))
    key = F.coalesce(*[F.expr(f"try_variant_get(_m['{k}'], '$', 'bigint')") for k in ROW_KEYS])
    cells = rows.select("template_id", "sheet_name", "period", "file_id", "pos", key.alias("row_key"), F.explode_outer("_m").alias("field", "_v"))
    cells = cells.filter(F.col("field").isNotNull() & ~F.col("field").isin(*ROW_KEYS, CHILDREN))
    return cells.select("template_id", "sheet_name", "period", "file_id", "pos", "row_key", "field", F.expr(json_type("_v")).alias("jtype"), F.expr("if(is_variant_null(_v), null, coalesce(try_variant_get(_v, '$', 'string'), to_json(_v)))").alias("value"))


def field_stats(cells: DataFrame) -> DataFrame:
    """Path-type statistics by file: how often each field occurs with which types."""
    return cells.groupBy(*SCOPE, "period", "file_id", "field").agg(F.count("*").alias("n_rows"), F.count("jtype").alias("n_values"), F.array_sort(F.collect_set("jtype")).alias("types"))


def sheet_changes(files: DataFrame) -> DataFrame:
    """Sheets that appear or vanish against the file before."""
    kept = _keep(files).select("template_id", "period", "file_id", F.map_keys(F.from_json("sheets", "map<string,string>")).alias("_now"))
    kept = kept.withColumn("_now", F.coalesce("_now", F.array().cast("array<string>")))
    before = F.lag("_now").over(W.partitionBy("template_id").orderBy("period", "file_id"))
    both = kept.withColumn("_old", before).filter(F.col("_old").isNotNull())
    change = lambda name, of: F.transform(of, lambda s: F.struct(s.alias("sheet_name"), F.lit(name).alias("change")))
    out = F.inline(F.concat(change("sheet_added", F.array_except("_now", "_old")), change("sheet_removed", F.array_except("_old", "_now"))))
    return both.select("template_id", "file_id", out).select("template_id", "file_id", "sheet_name", "change", F.lit("").alias("old_field"), F.lit("").alias("new_field"))


def compared(stats: DataFrame) -> DataFrame:
    """A row per (file, sheet) with rows and the nearest earlier one: file_id, prev_file, the fields of both with their types."""
    per = stats.groupBy(*SCOPE, "period", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "types"))).alias("now"))
    w = W.partitionBy(*SCOPE).orderBy("period", "file_id")
    return per.select("*", F.lag("file_id").over(w).alias("prev_file"), F.lag("now").over(w).alias("old")).filter("prev_file is not null")


def renames(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gone and new fields whose rows present in both files carry the same values; one partner each.

    Of several candidates the one with the most equal non-null rows wins, then the alphabetical order decides.
    """
    gone = pairs.select(*SCOPE, "file_id", F.col("prev_file").alias("_in"), F.explode(F.array_except(F.map_keys("old"), F.map_keys("now"))).alias("field"))
    new = pairs.select(*SCOPE, "file_id", F.explode(F.array_except(F.map_keys("now"), F.map_keys("old"))).alias("field"))
    both = new.select("file_id", "sheet_name").distinct()
    gone = gone.join(both, ["file_id", "sheet_name"], "left_semi")
    value = F.when(F.col("jtype").isNotNull(), F.xxhash64("jtype", "value")).alias("_v")
    keyed = cells.filter("row_key is not null").select(F.col("file_id").alias("_in"), "sheet_name", "row_key", "field", value)
    # only sheets with both gone and new fields, on either side, are compared row by row
    new = new.join(gone.select("file_id", "sheet_name").distinct(), ["file_id", "sheet_name"], "left_semi")
    needed = gone.select("_in", "sheet_name").unionByName(new.select(F.col("file_id").alias("_in"), "sheet_name")).distinct()
    keyed = keyed.join(needed, ["_in", "sheet_name"], "left_semi")
    # A row of the gone side and one of the new side meet on (file, sheet, row key). A row without the member counts as null there.
    fields = lambda side, name: side.groupBy("file_id", "sheet_name", *(["_in"] if name == "g" else [])).agg(F.collect_set("field").alias("_f"))
    per_row = keyed.groupBy("_in", "sheet_name", "row_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "_v"))).alias("_m"))
    old_rows = fields(gone, "g").join(per_row, ["_in", "sheet_name"]).select("file_id", "sheet_name", "row_key", F.transform("_f", lambda f: F.struct(f.alias("o"), F.col("_m")[f].alias("ov"))).alias("_o"))
    new_rows = fields(new, "n").join(per_row.withColumnRenamed("_in", "file_id"), ["file_id", "sheet_name"]).select("file_id", "sheet_name", "row_key", F.transform("_f", lambda f: F.struct(f.alias("n"), F.col("_m")[f].alias("nv"))).alias("_n"))
    met = old_rows.join(new_rows, ["file_id", "sheet_name", "row_key"]).select("file_id", "sheet_name", F.inline("_o"), "_n").select("file_id", "sheet_name", "o", "ov", F.inline("_n"))
    same = F.col("ov").eqNullSafe(F.col("nv"))
    scored = met.groupBy("file_id", "sheet_name", "o", "n").agg(F.min(same).alias("all_same"), F.sum((same & F.col("ov").isNotNull()).cast("long")).alias("n_same")).filter("all_same and n_same > 0")
    # greedy one-to-one on the few candidates of a file
    best = scored.groupBy("file_id", "sheet_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_same")).alias("r"), "o", "n"))).alias("c"))
    chosen = F.expr("aggregate(c, cast(array() as array<struct<r: bigint, o: string, n: string>>), (a, x) -> if(exists(a, y -> y.o = x.o or y.n = x.n), a, concat(a, array(x))))")
    return best.select("file_id", "sheet_name", F.inline(chosen)).select("file_id", "sheet_name", F.col("o").alias("old_field"), F.col("n").alias("new_field"))


def field_changes(files: DataFrame) -> DataFrame:
    """Every field change with the file where it first shows (template_id, period, file_id, sheet_name, change, old_field, new_field)."""
    return _field_changes(checkpointed(row_cells(files)))


def _field_changes(cells: DataFrame) -> DataFrame:
    pairs = compared(field_stats(cells))
    named = renames(cells, pairs).groupBy("file_id", "sheet_name").agg(F.collect_list(F.struct("old_field", "new_field")).alias("ren"))
    none = F.array().cast("array<struct<old_field: string, new_field: string>>")
    df = pairs.join(named, ["file_id", "sheet_name"], "left").withColumn("ren", F.coalesce("ren", none))
    entry = lambda kind, o, n: F.struct(F.lit(kind).alias("change"), o.alias("old_field"), n.alias("new_field"))
    gone = F.array_except(F.array_except(F.map_keys("old"), F.map_keys("now")), F.col("ren.old_field"))
    new = F.array_except(F.array_except(F.map_keys("now"), F.map_keys("old")), F.col("ren.new_field"))
    kept = F.filter(F.array_intersect(F.map_keys("old"), F.map_keys("now")), lambda f: (F.size(F.col("old")[f]) > 0) & (F.size(F.col("now")[f]) > 0) & (F.col("old")[f] != F.col("now")[f]))
    out = F.concat(
        F.transform("ren", lambda r: entry("renamed", r["old_field"], r["new_field"])),
        F.transform(gone, lambda f: entry("removed", f, F.lit(""))),
        F.transform(new, lambda f: entry("added", F.lit(""), f)),
        F.transform(kept, lambda f: entry("type_changed", f, f)),
    )
    return df.select("template_id", "period", "file_id", "sheet_name", F.inline(out))


def changes(files: DataFrame) -> DataFrame:
    """Sheet and field changes together: template_id, file_id, sheet_name, change, old_field, new_field."""
    cols = ["template_id", "file_id", "sheet_name", "change", "old_field", "new_field"]
    return sheet_changes(files).select(cols).unionByName(field_changes(files).select(cols))


def unified(files: DataFrame) -> DataFrame:
    """One consistent long table of all rows under the last name of each field, with typed columns.

    Columns: template_id, sheet_name, file_id, pos, row_key, field (last name), source_field, field_type, text_value,
    number_value, boolean_value, cast_failed. ``field_type`` is the only type seen for the field, or ``string`` where files
    differ and not every value reads as a number or boolean; a value that can't be read as the field's type keeps its text
    and has ``cast_failed`` set.
    """
    cells = checkpointed(row_cells(files))
    hist = _field_changes(cells).filter("change = 'renamed'").groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("period", "old_field", "new_field"))).alias("hist"))
    df = cells.join(hist, SCOPE, "left")
    last = F.expr("coalesce(aggregate(filter(hist, h -> h.period > period), field, (a, h) -> if(a = h.old_field, h.new_field, a)), field)")
    df = df.select(*SCOPE, "file_id", "pos", "row_key", last.alias("field"), F.col("field").alias("source_field"), "jtype", "value")
    number, boolean = F.expr("try_cast(value as double)"), F.expr("try_cast(value as boolean)")
    kinds = df.groupBy(*SCOPE, "field").agg(F.collect_set("jtype").alias("k"), F.count_if(F.col("jtype").isNotNull()).alias("n"), F.count_if((F.col("jtype") == "number") | number.isNotNull()).alias("nn"), F.count_if(F.col("jtype") == "number").alias("raw"), F.count_if(F.col("jtype") == "boolean").alias("nb"))
    kind = F.when(F.size("k") == 1, F.col("k")[0]).when((F.col("raw") * 2 >= F.col("n")) | (F.col("nn") == F.col("n")) & (F.col("raw") > 0), "number").when(F.col("nb") * 2 >= F.col("n"), "boolean").otherwise("string")
    df = df.join(kinds.select(*SCOPE, "field", kind.alias("field_type")), [*SCOPE, "field"], "left")
    num, boo = F.when(F.col("field_type") == "number", number), F.when(F.col("field_type") == "boolean", boolean)
    bad = F.col("value").isNotNull() & ((F.col("field_type") == "number") & num.isNull() | (F.col("field_type") == "boolean") & boo.isNull())
    return df.select(*SCOPE, "file_id", "pos", "row_key", "field", "source_field", "field_type", F.col("value").alias("text_value"), num.alias("number_value"), boo.alias("boolean_value"), F.coalesce(bad, F.lit(False)).alias("cast_failed"))
