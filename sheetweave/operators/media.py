"""Media items: maps, unique files, missing files, summaries and their place in the HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.names import sheet_of_media
from sheetweave.functions.text import html_escape

MAX_IMAGE_BYTES = 20_971_520


def delivered(media: DataFrame) -> DataFrame:
    """Each media id once, as last delivered."""
    rest = [c for c in media.columns if c not in ("media_id", "loaded_at")]
    return media.groupBy("media_id").agg(F.max_by(F.struct("loaded_at", *rest), F.struct("loaded_at", *[c for c in rest])).alias("b")).select("media_id", "b.*")


def media_map(media: DataFrame) -> DataFrame:
    """file_id, sheet_idx, coord (``unknown`` where there is none), filenames in order of ``idx``."""
    coord = F.coalesce("coord", F.lit("unknown"))
    g = media.groupBy("file_id", "sheet_idx", coord.alias("coord")).agg(F.array_sort(F.collect_list(F.struct("idx", "media_id", "filename"))).alias("m"))
    return g.select("file_id", "sheet_idx", "coord", F.col("m.filename").alias("filenames"))


def unique_media(media: DataFrame) -> DataFrame:
    """The first item of each file and name (by sheet and index); items without a name are dropped."""
    named = media.filter("filename is not null and filename <> ''")
    first = F.min_by(F.struct("sheet_idx", "idx", "media_id", "image_hash"), F.struct("sheet_idx", "idx", "media_id"))
    return named.groupBy("file_id", "filename").agg(first.alias("f")).select("file_id", "filename", "f.*")


def missing(media: DataFrame, present: DataFrame) -> DataFrame:
    """file_id, n_missing: named media without a file in ``present`` (filename)."""
    gone = media.filter("filename is not null and filename <> ''").select("file_id", "filename").distinct().join(present.select("filename").distinct(), "filename", "left_anti")
    return gone.groupBy("file_id").agg(F.count("*").alias("n_missing"))


def within_size(media: DataFrame, content: str = "bytes", limit: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Items whose bytes stay within the limit."""
    return media.filter(F.length(content) <= limit)


def with_results(media: DataFrame, results: DataFrame) -> DataFrame:
    """Summaries and chart data of analysed files (file_id, filename, visual_summary, visual_data) put onto all their items; empty ones change nothing."""
    new = results.groupBy("file_id", "filename").agg(F.max("visual_summary").alias("_s"), F.max("visual_data").alias("_d"))
    df = media.join(new, ["file_id", "filename"], "left")
    keep = lambda n, o: F.coalesce(F.nullif(F.col(n), F.lit("")), F.col(o))
    return df.withColumn("visual_summary", keep("_s", "visual_summary")).withColumn("visual_data", keep("_d", "visual_data")).drop("_s", "_d")


def by_sheet_name(media: DataFrame) -> DataFrame:
    """Media with the sheet name their file name begins with."""
    return media.withColumn("sheet_name", sheet_of_media(F.col("filename")))


def insight(coord: Column, text: Column) -> Column:
    """Chart data as an HTML box."""
    return F.concat(F.lit("<div class='visual-insight'>[図表データ("), coord, F.lit(")]: "), html_escape(text), F.lit("</div>"))


def with_insights(html: DataFrame, media: DataFrame) -> DataFrame:
    """Chart data written into the table cells they belong to (after the coordinate attribute), all of a sheet in one fold."""
    boxes = media.filter("coalesce(visual_data, '') <> '' and coord is not null").select("file_id", "sheet_idx", "coord", "idx", "media_id", insight(F.col("coord"), F.col("visual_data")).alias("box"))
    per = boxes.groupBy("file_id", "sheet_idx", "coord").agg(F.array_sort(F.collect_list(F.struct("idx", "media_id", "box"))).alias("b"))
    per = per.select("file_id", "sheet_idx", "coord", F.array_join(F.col("b.box"), "").alias("box"))
    sheet = per.groupBy("file_id", "sheet_idx").agg(F.array_sort(F.collect_list(F.struct("coord", "box"))).alias("boxes"))
    attr = lambda x: F.concat(F.lit('data-coord="'), x["coord"], F.lit('"'))
    fold = F.aggregate("boxes", F.col("html"), lambda h, x: F.replace(h, attr(x), F.concat(attr(x), x["box"])))
    return html.join(sheet, ["file_id", "sheet_idx"], "left").withColumn("html", F.coalesce(fold, F.col("html"))).drop("boxes")
