"""Queries over the input tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions import cells as cellfn
from sheetweave.functions import coords, names, text
from sheetweave.operators import cache, documents, drift, grid, match, model, nested
from sheetweave.operators import chunks as chunkops
from sheetweave.operators import markdown as mdops
from sheetweave.operators import media as mediaops
from sheetweave.session import table
from sheetweave.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- nested records and drifting schemas ----
@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every schema change of a template with the file where it first shows."""
    return drift.changes(table(spark, d, "full_extractions"))


@query()
def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All rows in one consistent typed table."""
    return drift.unified(table(spark, d, "full_extractions"))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every nested record with its parent."""
    return nested.all_nodes(table(spark, d, "full_extractions"))


@query()
def p5_sections(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "full_extractions"), "sections", {"title": "string", "level": "int", "note": "string"})


@query()
def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "full_extractions"), "entries", {"label": "string", "value": "string", "coord": "string", "tags": "string"})


@query()
def p5_media(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "full_extractions"), "media", {"coord": "string", "filename": "string", "type": "string", "visual_summary": "string", "visual_data": "string"})


@query()
def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of data with the whole record as JSON beside its links."""
    return nested.row_table(table(spark, d, "full_extractions"))


@query()
def p5_lots(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "full_extractions"), "lots", {"lot": "string", "pcs": "long"})


# ---- scalar functions ----
_WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_CJK = r"[\x{4e00}-\x{9faf}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


_clean1 = f"regexp_replace(replace(value, chr(12288), ' '), '({_CJK}){_WS}{{1,3}}({_CJK})', '\\1\\2', 'g')"
_clean2 = f"regexp_replace({_clean1}, '({_CJK}){_WS}{{1,3}}({_CJK})', '\\1\\2', 'g')"


@query(f"SELECT cell_id, {_sql_strip(_clean2)} AS cleaned FROM cells")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").select("cell_id", text.clean_cjk(F.col("value")).alias("cleaned"))


_ESC = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(f"SELECT doc_id, {_ESC} AS html, replace(replace(text, '|', '\\|'), chr(10), '<br>') AS md FROM documents")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.html_escape(F.col("text")).alias("html"), text.md_escape(F.col("text")).alias("md"))


_FORMATS = ["General", '"¥"#,##0', "$#,##0.00", "0.00%", "yyyy-mm-dd", "[$-411]yyyy", "@", "", "d/MM/yy"]


@query(
    """
    WITH f AS (SELECT cell_id, list_extract(['General', '"¥"#,##0', '$#,##0.00', '0.00%', 'yyyy-mm-dd', '[$-411]yyyy', '@', '', 'd/MM/yy'], (cell_id % 9 + 1)::INT) AS fmt FROM cells)
    SELECT cell_id, CASE WHEN fmt IN ('', 'General') THEN NULL WHEN contains(fmt, '¥') OR contains(lower(fmt), 'jpy') THEN 'JPY' WHEN contains(fmt, '$') THEN 'USD'
      WHEN contains(fmt, '%') THEN 'PERCENT' WHEN regexp_matches(lower(fmt), 'yy|mm|dd') THEN 'DATE' ELSE fmt END AS unit_class FROM f
    """
)
def unit_class(spark: SparkSession, d: str) -> DataFrame:
    fmt = F.array(*[F.lit(x) for x in _FORMATS])[(F.col("cell_id") % 9).cast("int")]
    return table(spark, d, "cells").select("cell_id", cellfn.unit_of(fmt).alias("unit_class"))


@query(
    """
    SELECT cell_id, try_cast(nullif(regexp_extract(upper(coord), '^([A-Z]+)([0-9]+)$', 2), '') AS INT) AS r,
      CASE WHEN regexp_extract(upper(coord), '^([A-Z]+)([0-9]+)$', 1) <> '' THEN list_reduce([0] || list_transform(string_split(regexp_extract(upper(coord), '^([A-Z]+)([0-9]+)$', 1), ''), lambda x: (ascii(x) - 64)::INT), lambda a, x: a * 26 + x) END AS c,
      CASE WHEN col_idx > 702 THEN chr((65 + (col_idx - 703) // 676)::INT) ELSE '' END || CASE WHEN col_idx > 26 THEN chr((65 + (col_idx - 27) // 26 % 26)::INT) ELSE '' END || chr((65 + (col_idx - 1) % 26)::INT) || row_idx AS coord_again
    FROM cells
    """
)
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cells")
    return c.select("cell_id", coords.row_of(F.col("coord")).alias("r"), coords.col_of(F.col("coord")).alias("c"), coords.coord_name(F.col("row_idx"), F.col("col_idx")).alias("coord_again"))


@query(
    """
    SELECT cell_id, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(loaded_at) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(loaded_at) % 1000000)::VARCHAR, 6, '0') END AS iso
    FROM cells
    """
)
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").select("cell_id", text.iso_time(F.col("loaded_at")).alias("iso"))


@query(
    """
    SELECT request_id, model || ':' || sha256(system_prompt) || ':' || sha256(input_text) AS key, sha256(input_text) || ':logic=True' AS raw_key,
      'data:image/png;base64,' || base64(encode(system_prompt)) AS url FROM llm_requests
    """
)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "llm_requests")
    return r.select("request_id", text.llm_key(F.col("model"), F.col("system_prompt"), F.col("input_text")).alias("key"), text.raw_key(F.sha2("input_text", 256), True).alias("raw_key"), text.data_url(F.encode("system_prompt", "utf-8")).alias("url"))


@query(
    """
    SELECT media_id, CASE WHEN contains(filename, '_img_') THEN string_split(filename, '_img_')[1] ELSE string_split(filename, '_')[1] END AS sheet,
      CASE WHEN coalesce(visual_summary, '') = '' THEN NULL WHEN starts_with(visual_summary, '[画像概要]') THEN replace(visual_summary, '[画像概要]', '**[画像概要]**:')
      ELSE '**[画像概要]**: ' || visual_summary END AS summary FROM media
    """
)
def media_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media").select("media_id", names.sheet_of_media(F.col("filename")).alias("sheet"), text.media_summary(F.col("visual_summary")).alias("summary"))


@query()
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of all titles (compatibility decomposition has no SQL)."""
    return table(spark, d, "documents").select("doc_id", names.safe_name_column(F.col("title")).alias("name"))


_NOTE = "'> ℹ️ セル ' || coord || ' は計算式 `' || formula || '`' || CASE WHEN coalesce(unit, '') <> '' THEN '（単位: ' || unit || '）' ELSE '' END || ' から導出された集計値です。'"


@query(f"SELECT cell_id, coalesce(starts_with(formula, '='), false) AS is_formula, CASE WHEN coalesce(regexp_matches(formula, '(?i)=(SUM|AVERAGE|AVG|COUNT|MAX|MIN|SUBTOTAL|VLOOKUP|IF|ROUND)\\b'), false) THEN {_NOTE} END AS note FROM cells")
def formula_notes(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(cellfn.is_aggregate(F.col("formula")), cellfn.logic_note(F.col("coord"), F.col("formula"), F.col("unit")))
    return table(spark, d, "cells").select("cell_id", cellfn.is_formula(F.col("formula")).alias("is_formula"), note.alias("note"))


# ---- grid ----
_CELLS = "(SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY file_id, sheet_idx, coord ORDER BY loaded_at DESC, cell_id DESC) = 1)"
_RANGES = f"(SELECT file_id, sheet_idx, row_idx AS min_row, row_idx + coalesce(rowspan, 1) - 1 AS max_row, col_idx AS min_col, col_idx + coalesce(colspan, 1) - 1 AS max_col FROM {_CELLS} WHERE coalesce(colspan, 1) > 1 OR coalesce(rowspan, 1) > 1)"
_BOX = f"""(SELECT file_id, sheet_idx, 1 AS min_row, max(r) AS max_row, 1 AS min_col, max(c) AS max_col FROM (
    SELECT file_id, sheet_idx, row_idx AS r, col_idx AS c FROM {_CELLS} WHERE value IS NOT NULL OR starts_with(coalesce(formula, ''), '=')
    UNION ALL SELECT file_id, sheet_idx, max_row, max_col FROM {_RANGES}) GROUP BY ALL)"""
_MERGED = f"(SELECT file_id, sheet_idx, r AS row_idx, c AS col_idx, r = min_row AND c = min_col AS is_anchor, min_row, max_row, min_col, max_col FROM {_RANGES}, unnest(range(min_row, max_row + 1)) AS a(r), unnest(range(min_col, max_col + 1)) AS b(c))"
_DENSE = f"""(SELECT g.file_id, g.sheet_idx, g.r AS row_idx, g.c AS col_idx, x.value, x.formula, x.unit, x.style, x.colspan, x.rowspan
    FROM (SELECT file_id, sheet_idx, r, c FROM {_BOX}, unnest(range(1, max_row + 1)) AS a(r), unnest(range(1, max_col + 1)) AS b(c)) g
    ANTI JOIN (SELECT * FROM {_MERGED} WHERE NOT is_anchor) m ON m.file_id = g.file_id AND m.sheet_idx = g.sheet_idx AND m.row_idx = g.r AND m.col_idx = g.c
    LEFT JOIN {_CELLS} x ON x.file_id = g.file_id AND x.sheet_idx = g.sheet_idx AND x.row_idx = g.r AND x.col_idx = g.c)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.delivered(table(spark, d, "cells"))


@query(f"SELECT * FROM {_BOX}")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return grid.bounding_box(c, grid.ranges_of(c))


@query(f"SELECT file_id, sheet_idx, row_idx, col_idx, is_anchor, CASE WHEN is_anchor THEN max_col - min_col + 1 END AS colspan, CASE WHEN is_anchor THEN max_row - min_row + 1 END AS rowspan FROM {_MERGED}")
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.merged_cells(grid.ranges_of(_cells(spark, d)))


@query(f"SELECT file_id, sheet_idx, row_idx, col_idx, value, formula FROM {_DENSE}")
def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.dense(_cells(spark, d)).select("file_id", "sheet_idx", "row_idx", "col_idx", "value", "formula")


_SIDE = " || ".join(
    f"""coalesce(list_aggregate(list_transform(list_filter(style.borders, lambda b: b.side = '{s}' AND b.line IS NOT NULL)[:1], lambda b: 'border-{s}: ' || CASE b.line WHEN 'medium' THEN '2px solid' WHEN 'thick' THEN '3px solid' WHEN 'dashed' THEN '1px dashed' WHEN 'dotted' THEN '1px dotted' ELSE '1px solid' END || ' black; '), 'string_agg', ''), '')"""
    for s in ("left", "right", "top", "bottom")
)
_CSS = f"rtrim(coalesce({_SIDE}, '') || CASE WHEN style.bold THEN 'font-weight: bold; ' ELSE '' END, '; ')"
_H = lambda x: f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_TD = f"""'<td data-coord="' || coord || '"' || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END
    || CASE WHEN css <> '' THEN ' style="' || css || '"' ELSE '' END || CASE WHEN starts_with(coalesce(formula, ''), '=') THEN ' data-formula="' || {_H("formula")} || '"' ELSE '' END
    || CASE WHEN coalesce(unit, '') <> '' THEN ' data-unit="' || {_H("unit")} || '"' ELSE '' END || '>' || replace({_H("coalesce(value, '')")}, chr(10), '<br>') || '</td>'"""


@query(
    f"""
    WITH t AS (SELECT *, CASE WHEN col_idx <= 26 THEN chr((64 + col_idx)::INT) ELSE chr((64 + (col_idx - 1) // 26)::INT) || chr((65 + (col_idx - 1) % 26)::INT) END || row_idx AS coord, {_CSS} AS css FROM {_DENSE}),
    x AS (SELECT file_id, sheet_idx, row_idx, string_agg({_TD}, '' ORDER BY col_idx) AS tds FROM t GROUP BY ALL),
    b AS (SELECT file_id, sheet_idx, max_row, r AS row_idx FROM {_BOX}, unnest(range(1, max_row + 1)) AS a(r)),
    r AS (SELECT file_id, sheet_idx, row_idx, max_row, '  <tr>' || coalesce(tds, '') || '</tr>' AS tr FROM b LEFT JOIN x USING (file_id, sheet_idx, row_idx))
    SELECT file_id, sheet_idx, ((row_idx - 1) // 2000)::INT AS part_no, CASE WHEN (min(row_idx) = 1) THEN '<table border=''1'' style="border-collapse: collapse; min-width: 100%;">' || chr(10) ELSE '' END || string_agg(tr, chr(10) ORDER BY row_idx)
      || CASE WHEN max(row_idx) = max(max_row) THEN chr(10) || '</table>' ELSE chr(10) END AS html FROM r GROUP BY ALL
    """
)
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    return grid.html_tables(_cells(spark, d), rows_per_part=2000)


_SIMPLE = f"""(SELECT file_id, sheet_idx, coalesce(max(row_idx) FILTER (WHERE value IS NOT NULL) >= 2 AND count(*) FILTER (WHERE row_idx = 1 AND value IS NOT NULL) >= 2
    AND count(*) FILTER (WHERE coalesce(colspan, 1) > 1 OR coalesce(rowspan, 1) > 1) = 0, false) AS is_simple FROM {_CELLS} GROUP BY ALL)"""


@query(f"SELECT * FROM {_SIMPLE}")
def simple_sheets(spark: SparkSession, d: str) -> DataFrame:
    return grid.simple_sheets(_cells(spark, d))


@query(
    f"""
    SELECT b.file_id, b.sheet_idx, b.row_idx, b.col_idx, CASE WHEN coalesce(h.value, '') = '' OR h.value_type = 'n' AND try_cast(h.value AS DOUBLE) = 0 OR h.value_type = 'b' AND lower(h.value) = 'false' THEN 'Column' || b.col_idx ELSE h.value END AS header, b.value
    FROM {_CELLS} b SEMI JOIN (SELECT * FROM {_SIMPLE} WHERE is_simple) s USING (file_id, sheet_idx)
    LEFT JOIN (SELECT file_id, sheet_idx, col_idx, value, value_type FROM {_CELLS} WHERE row_idx = 1) h USING (file_id, sheet_idx, col_idx)
    WHERE b.row_idx > 1 AND b.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY b.file_id, b.sheet_idx, b.row_idx, header ORDER BY b.col_idx DESC) = 1
    """
)
def simple_rows(spark: SparkSession, d: str) -> DataFrame:
    return grid.simple_rows(_cells(spark, d)).drop("json")


# ---- media ----
_MEDIA = "(SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY loaded_at DESC) = 1)"


@query(f"SELECT file_id, sheet_idx, coalesce(coord, 'unknown') AS coord, string_agg(filename, ',' ORDER BY idx, media_id) AS filenames FROM {_MEDIA} GROUP BY ALL")
def media_map(spark: SparkSession, d: str) -> DataFrame:
    m = mediaops.media_map(mediaops.delivered(table(spark, d, "media")))
    return m.withColumn("filenames", F.nullif(F.array_join("filenames", ","), F.lit("")))


@query(f"SELECT file_id, filename, sheet_idx, idx, media_id, image_hash FROM {_MEDIA} WHERE coalesce(filename, '') <> '' QUALIFY row_number() OVER (PARTITION BY file_id, filename ORDER BY sheet_idx, idx, media_id) = 1")
def unique_media(spark: SparkSession, d: str) -> DataFrame:
    return mediaops.unique_media(mediaops.delivered(table(spark, d, "media")))


@query(f"SELECT file_id, count(DISTINCT filename) AS n_missing FROM {_MEDIA} WHERE coalesce(filename, '') <> '' AND filename NOT IN (SELECT filename FROM media WHERE visual_summary IS NOT NULL AND filename IS NOT NULL) GROUP BY ALL")
def media_missing(spark: SparkSession, d: str) -> DataFrame:
    """Files whose media nobody has summarised yet."""
    m = table(spark, d, "media")
    return mediaops.missing(mediaops.delivered(m), m.filter("visual_summary is not null"))


@query()
def html_with_insights(spark: SparkSession, d: str) -> DataFrame:
    return mediaops.with_insights(grid.html_tables(_cells(spark, d), rows_per_part=2000), mediaops.delivered(table(spark, d, "media")))


# ---- sections, chunks, matches ----
def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_items").dropDuplicates(["item_no"])


_ITEMS = "(SELECT * FROM rag_items QUALIFY row_number() OVER (PARTITION BY item_no) = 1)"
_LINE = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_SECTIONS = f"""(SELECT item_no, file_id, sheet_name, row_number() OVER (PARTITION BY item_no ORDER BY i) - 1 AS section_no, body FROM (
    SELECT item_no, file_id, metadata.sheet_name AS sheet_name, i, {_sql_strip("CASE WHEN i = 1 THEN p[i] ELSE '# ' || p[i] END")} AS body FROM (SELECT *, string_split(chr(10) || content, chr(10) || '# ') AS p FROM {_ITEMS}) t, unnest(range(1, len(p) + 1)) AS u(i)) WHERE body <> '')"""


@query(f"SELECT item_no, section_no::INT AS section_no, body, CASE WHEN regexp_extract(body, '^#+\\s+([^\\n\\r]*)', 1) = '' THEN '全般' ELSE regexp_extract(body, '^#+\\s+([^\\n\\r]*)', 1) END AS section FROM {_SECTIONS}")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return chunkops.with_sections(_items(spark, d).select("item_no", "content"), "content").select("item_no", "section_no", "body", "section")


@query(
    f"""
    WITH RECURSIVE l AS (SELECT item_no, coalesce(max_chunk_chars, 1000) AS lim, coalesce(chunk_overlap_lines, 2) AS ov, CASE WHEN content = '' THEN [] WHEN a[-1] = '' THEN a[:-2] ELSE a END AS ls
      FROM (SELECT *, regexp_split_to_array(content, '{_LINE}') AS a FROM {_ITEMS} LEFT JOIN rag_options USING (option_id) WHERE content IS NOT NULL)),
    r AS (SELECT item_no, lim, ov, 0::BIGINT AS i, []::VARCHAR[] AS cur, 0::BIGINT AS n, []::VARCHAR[] AS done, ls FROM l
      UNION ALL
      SELECT item_no, lim, ov, i + 1, CASE WHEN f THEN list_append(k, x) ELSE list_append(cur, x) END,
        CASE WHEN f THEN coalesce(list_sum(list_transform(k, lambda y: length(y) + 1)), 0) + length(x) + 1 ELSE n + length(x) + 1 END,
        CASE WHEN f THEN list_append(done, array_to_string(cur, chr(10))) ELSE done END, ls
      FROM (SELECT *, ls[i + 1] AS x, (n + length(ls[i + 1]) + 1 > lim AND len(cur) > 0) AS f, CASE WHEN ov > 0 AND len(cur) >= ov THEN cur[len(cur) - ov + 1:] ELSE []::VARCHAR[] END AS k FROM r WHERE i < len(ls))),
    e AS (SELECT item_no, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, chr(10))) ELSE done END AS c FROM r WHERE i = len(ls))
    SELECT item_no, j::INT AS chunk_index, len(c)::INT AS total_chunks, c[j] AS content FROM e, unnest(range(1, len(c) + 1)) AS u(j)
    """
)
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Line-packed chunks of each item under its own option."""
    o = table(spark, d, "rag_options").select("option_id", "max_chunk_chars", "chunk_overlap_lines")
    df = _items(spark, d).select("item_no", "option_id", "content").filter("content is not null").join(o, "option_id", "left")
    c = chunkops.fold_chunks(F.col("content"), F.coalesce("max_chunk_chars", F.lit(1000)), F.coalesce("chunk_overlap_lines", F.lit(2)))
    return df.select("item_no", c.alias("c")).select("item_no", F.size("c").alias("total_chunks"), F.posexplode("c").alias("p", "content")).select("item_no", (F.col("p") + 1).alias("chunk_index"), "total_chunks", "content")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    s = _items(spark, d).select("item_no", "file_id", F.col("metadata.sheet_name").alias("sheet_name"), "content")
    s = chunkops.with_sections(s, "content").select("file_id", "sheet_name", F.concat_ws("#", "item_no", "section_no").alias("section_no"), "body")
    # a sheet's head row is a section as well
    heads = _cells(spark, d).filter("row_idx = 1 and value is not null").groupBy("file_id", "sheet_name", "sheet_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("h"))
    return s.unionByName(heads.select("file_id", "sheet_name", F.concat(F.lit("head#"), F.col("sheet_idx").cast("string")).alias("section_no"), F.array_join(F.col("h.value"), " ").alias("body")))


_MATCH = f"""(SELECT s.file_id, s.sheet_name, s.section_no, c.coord, c.formula, c.unit, c.row_idx, c.col_idx FROM (SELECT file_id, sheet_name, item_no || '#' || section_no AS section_no, body FROM {_SECTIONS}
    UNION ALL SELECT file_id, sheet_name, 'head#' || sheet_idx, string_agg(value, ' ' ORDER BY col_idx) FROM {_CELLS} WHERE row_idx = 1 AND value IS NOT NULL GROUP BY file_id, sheet_name, sheet_idx) s JOIN {_CELLS} c USING (file_id, sheet_name)
    WHERE c.value IS NOT NULL AND {_sql_strip("lower(c.value)")} <> '' AND NOT regexp_full_match({_sql_strip("lower(c.value)")}, '\\p{{Nd}}') AND contains(lower(s.body), {_sql_strip("lower(c.value)")}))"""


@query(f"SELECT file_id, sheet_name, section_no, coord, formula, unit FROM {_MATCH}")
def value_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.value_matches(_sections(spark, d), _cells(spark, d))


@query(
    f"""
    WITH m AS (SELECT file_id, sheet_name, section_no, min(row_idx) AS r1, min(col_idx) AS c1, max(row_idx) AS r2, max(col_idx) AS c2, bool_or(starts_with(coalesce(formula, ''), '=')) AS has_formulas FROM {_MATCH} GROUP BY ALL),
    n AS (SELECT *, CASE WHEN c1 <= 26 THEN chr((64 + c1)::INT) ELSE chr((64 + (c1 - 1) // 26)::INT) || chr((65 + (c1 - 1) % 26)::INT) END || r1 AS a, CASE WHEN c2 <= 26 THEN chr((64 + c2)::INT) ELSE chr((64 + (c2 - 1) // 26)::INT) || chr((65 + (c2 - 1) % 26)::INT) END || r2 AS b FROM m)
    SELECT file_id, sheet_name, section_no, CASE WHEN a = b THEN a ELSE a || ':' || b END AS coordinates, has_formulas FROM n
    """
)
def section_facts(spark: SparkSession, d: str) -> DataFrame:
    m = match.value_matches(_sections(spark, d), _cells(spark, d))
    return match.section_facts(m).select("file_id", "sheet_name", "section_no", "coordinates", "has_formulas")


@query()
def rag_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Contextual chunks of every item with provenance."""
    c = _cells(spark, d)
    sheets = c.select("file_id", "sheet_idx", "sheet_name").distinct()
    m = mediaops.delivered(table(spark, d, "media")).join(sheets, ["file_id", "sheet_idx"])
    # an item is a sheet's Markdown of its own
    own = _items(spark, d).select(F.concat_ws("#", "file_id", "item_no").alias("file_id"), F.col("file_id").alias("_f"), F.col("metadata.sheet_name").alias("sheet_name"), F.col("metadata.source_file").alias("source_file"), F.col("content").alias("markdown")).filter("markdown is not null")
    ids = own.select(F.col("file_id").alias("_i"), F.col("_f").alias("file_id"), "sheet_name")
    near = lambda t: t.join(ids, ["file_id", "sheet_name"]).drop("file_id").withColumnRenamed("_i", "file_id")
    return chunkops.contextual_chunks(own, near(c), near(m), "2025-01-01T00:00:00")


@query(
    f"""
    WITH r AS (SELECT cell_id AS row_no, file_id, upper(coord) AS coordinate, row_idx AS rr, col_idx AS rc FROM {_CELLS} WHERE formula IS NOT NULL),
    m AS (SELECT file_id, idx, coord, filename, try_cast(nullif(regexp_extract(coord, '^([A-Z]+)([0-9]+)$', 2), '') AS INT) AS mr,
      list_reduce([0] || list_transform(string_split(regexp_extract(coord, '^([A-Z]+)([0-9]+)$', 1), ''), lambda x: (ascii(x) - 64)::INT), lambda a, x: a * 26 + x) AS mc FROM {_MEDIA} WHERE coord IS NOT NULL AND regexp_matches(coord, '^([A-Z]+)([0-9]+)$')),
    h AS (SELECT r.file_id, row_no, CASE WHEN coordinate = upper(coord) THEN 1 WHEN (mc = rc AND abs(mr - rr) <= 5) OR (mr = rr AND abs(mc - rc) <= 5) THEN 3 END AS rule, idx, coord, filename FROM r JOIN m USING (file_id))
    SELECT * FROM h WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, row_no ORDER BY rule, idx, coord NULLS FIRST, filename NULLS FIRST) = 1
    """
)
def associate(spark: SparkSession, d: str) -> DataFrame:
    """The media item next to each formula cell."""
    none = F.lit(None).cast("string")
    rows = _cells(spark, d).filter("formula is not null").select("file_id", F.col("cell_id").alias("row_no"), F.col("coord").alias("coordinate"), none.alias("area_start"), none.alias("area_end"))
    return match.associate(rows, mediaops.delivered(table(spark, d, "media")).filter("coord is not null"))


@query(
    f"""
    WITH v AS (SELECT DISTINCT file_id, sheet_name, coord AS key, {_sql_strip("value")} AS v FROM {_CELLS} WHERE unit IS NOT NULL AND value IS NOT NULL),
    h AS (SELECT v.file_id, v.sheet_name, v.key, v.v AS value, CASE WHEN v.v <> '' AND {_sql_strip("c.value")} <> '' AND v.v = {_sql_strip("c.value")} THEN 1 WHEN v.v <> '' AND {_sql_strip("c.value")} <> '' AND contains({_sql_strip("c.value")}, v.v) THEN 2 WHEN contains({_sql_strip("c.value")}, v.key) THEN 3 END AS rule, c.row_idx, c.col_idx, c.coord
      FROM v JOIN {_CELLS} c USING (file_id, sheet_name) WHERE c.value IS NOT NULL)
    SELECT file_id, sheet_name, key, value, rule, coord FROM h WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, sheet_name, key, value ORDER BY rule, row_idx, col_idx, coord) = 1
    """
)
def find_coord(spark: SparkSession, d: str) -> DataFrame:
    """Where the values with a unit stand."""
    c = _cells(spark, d)
    v = c.filter("unit is not null and value is not null").select("file_id", "sheet_name", F.col("coord").alias("key"), "value").distinct()
    return match.find_coord(v, c)


@query(
    f"""
    WITH a AS (SELECT item_no, i - 1 AS line_no, l[i] AS line FROM (SELECT item_no, CASE WHEN content = '' THEN [] WHEN x[-1] = '' THEN x[:-2] ELSE x END AS l FROM (SELECT item_no, content, regexp_split_to_array(content, '{_LINE}') AS x FROM {_ITEMS} WHERE content IS NOT NULL)), unnest(range(1, len(l) + 1)) AS u(i)),
    k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN starts_with(trim(line), '|') THEN 'table' WHEN starts_with(trim(line), '#') THEN 'header' WHEN regexp_matches(trim(line), '^[-*](\\s+|$)') THEN 'list' WHEN starts_with(trim(line), '![') THEN 'image' ELSE 'text' END AS kind FROM a),
    s AS (SELECT *, CASE WHEN kind NOT IN ('table', 'list') OR kind <> coalesce(lag(kind) OVER w, '') THEN 1 ELSE 0 END AS st FROM k WINDOW w AS (PARTITION BY item_no ORDER BY line_no))
    SELECT item_no, line_no::INT AS line_no, line, kind, sum(st) OVER (PARTITION BY item_no ORDER BY line_no)::BIGINT AS block_no FROM s
    """
)
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return documents.line_table(_items(spark, d).filter("content is not null"), "item_no", "content")


@query(
    """
    SELECT media_id, a AS alt, b AS path FROM (
        SELECT media_id, coalesce(coord, '') AS a, 'media/' || filename || '(1)' AS b FROM (SELECT DISTINCT media_id, coord, filename FROM media WHERE filename IS NOT NULL)
        UNION ALL SELECT media_id, 'second', 'a(b(c)d)' FROM (SELECT DISTINCT media_id, coord, filename FROM media WHERE filename IS NOT NULL))
    """
)
def image_refs(spark: SparkSession, d: str) -> DataFrame:
    """References with nested parentheses, an unbalanced one between them, from every named image."""
    m = table(spark, d, "media").filter("filename is not null").select("media_id", "coord", "filename").distinct()
    text = F.concat(F.lit("see !["), F.coalesce("coord", F.lit("")), F.lit("](media/"), "filename", F.lit("(1)) ![second](a(b(c)d)) and ![open](never(closed\n")).alias("t")
    return m.select("media_id", text).select("media_id", F.explode(documents.image_refs(F.col("t"))).alias("i")).select("media_id", "i.alt", "i.path")


@query()
def html_documents(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_no", documents.html_documents(F.col("content")).alias("html"))


@query(f"SELECT item_no, coalesce(content, '') AS content, metadata.section AS section FROM {_ITEMS}")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read again."""
    line = _items(spark, d).select("item_no", sinks.jsonl_line(F.col("content"), F.col("metadata")).alias("l"))
    return line.select("item_no", F.from_json("l", "content string, metadata struct<section: string>").alias("j")).select("item_no", "j.content", "j.metadata.section")


# ---- Markdown ----
@query("SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY ALL")
def md_table(spark: SparkSession, d: str) -> DataFrame:
    return mdops.flat_table(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])


@query("SELECT n_regionkey, string_agg('- n_nationkey: ' || n_nationkey || ', n_name: ' || n_name, chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY ALL")
def md_kv(spark: SparkSession, d: str) -> DataFrame:
    return mdops.flat_kv(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])


@query()
def md_structured(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of every structured result."""
    r = table(spark, d, "extraction_results").dropDuplicates(["result_id"])
    return r.select("result_id", mdops.markdown(F.col("data")).alias("markdown"))


@query()
def uniform_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose rows all have the same members."""
    return mdops.uniform_keys(nested.row_table(table(spark, d, "full_extractions")), ["file_id", "sheet_name"], ["pos"], "record").select("file_id", "sheet_name", "uniform")


# ---- caches and responses ----
_CURRENT = "(SELECT cache_key, content, ts, loaded_at FROM llm_cache QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, loaded_at DESC, content DESC NULLS LAST) = 1)"


@query(f"SELECT cache_key, ts, content FROM {_CURRENT}")
def cache_current(spark: SparkSession, d: str) -> DataFrame:
    return cache.current(table(spark, d, "llm_cache")).select("cache_key", "ts", "content")


@query(f"SELECT request_id, cache_key, content FROM llm_requests JOIN {_CURRENT} USING (cache_key)")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return cache.hits(table(spark, d, "llm_requests").select("request_id", "cache_key"), table(spark, d, "llm_cache")).select("request_id", "cache_key", "content")


@query("SELECT request_id, cache_key FROM llm_requests WHERE cache_key NOT IN (SELECT cache_key FROM llm_cache WHERE cache_key IS NOT NULL)")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return cache.misses(table(spark, d, "llm_requests").select("request_id", "cache_key"), table(spark, d, "llm_cache"))


@query()
def responses(spark: SparkSession, d: str) -> DataFrame:
    """Every cached response read as data or error."""
    return model.parsed(cache.current(table(spark, d, "llm_cache")).select("cache_key", "content")).select("cache_key", "data", "error", "raw_data")


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) <= 5000")
def size_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length("text") <= 5000).select("doc_id", "n_chars")
