"""One object from workbooks to structured data, chunks and documents, and its command line."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions.cells import unit_of
from sheetweave.functions.names import model_name
from sheetweave.functions.text import clean_cjk
from sheetweave.operators import chunks, documents, grid, markdown, model
from sheetweave.operators import media as pictures
from sheetweave.session import checkpointed, shipped
from sheetweave.sources import sinks, xlsx

SUMMARY_PROMPT = "この画像の内容を詳細に説明してください。[画像概要] と付けて出力してください。"
CHART_PROMPT = "この画像がグラフや図表の場合、その軸ラベル、凡例、およびデータ値を抽出し、Markdownのテーブル形式で整理してください。回答の冒頭に [図表データ] と付けて出力してください。"
LOGIC_NOTES = "- data-formula属性はセルの計算式を示しており、=SUM(...) 等は合計値を意味します。\n- data-unit属性はセルの単位（JPY, PERCENT等）です。"
DEFAULT_PROMPT = "Turn the table into structured records and answer with one fenced json block."


def _env(name: str, default: str) -> str:
    return os.environ.get(name, default)


@dataclass(frozen=True)
class ExtractionOptions:
    model: str | None = None
    system_prompt: str = DEFAULT_PROMPT
    include_visual_summaries: bool = False
    use_visual_context: bool = True
    include_logic: bool = False
    dpi: int = 150
    max_file_size_mb: int = 50
    use_cache: bool = True


@dataclass(frozen=True)
class RagOptions:
    list_format: str = "kv"
    output_format: str = field(default_factory=lambda: _env("RAG_OUTPUT_FORMAT", "markdown"))
    max_chunk_chars: int = field(default_factory=lambda: int(_env("RAG_MAX_CHUNK_CHARS", "1000")))
    chunk_overlap_lines: int = field(default_factory=lambda: int(_env("RAG_CHUNK_OVERLAP_LINES", "2")))
    include_coordinates: bool = field(default_factory=lambda: _env("RAG_INCLUDE_COORDINATES", "true").lower() in ("1", "true", "yes"))
    include_logic_annotations: bool = field(default_factory=lambda: _env("RAG_INCLUDE_LOGIC_ANNOTATIONS", "true").lower() in ("1", "true", "yes"))


class Engine:
    """Paths of many workbooks in, DataFrames out. ``client`` answers for the model, else a server at ``base_url``; without either
    a sheet that needs a model is an error. ``cache_path`` keeps the answers."""

    def __init__(self, spark: SparkSession, client: model.Client | None = None, cache_path: str | None = None, concurrency: int | None = None, base_url: str | None = None, api_key: str | None = None, timeout: float | None = None) -> None:
        url = base_url or os.environ.get("LLM_BASE_URL") or os.environ.get("OLLAMA_BASE_URL")
        key = api_key or os.environ.get("LLM_API_KEY") or os.environ.get("GEMINI_API_KEY")
        own = model.HttpClient(url, key, timeout or float(_env("LLM_TIMEOUT", "600"))) if url else model.NoClient()
        self.spark, self.client, self.cache_path = shipped(spark), client or own, cache_path
        self.concurrency = concurrency or int(_env("LLM_RPM_LIMIT", "8"))
        self._analysed: dict[tuple[str, ExtractionOptions], DataFrame] = {}

    def _books(self, path: str, max_mb: int) -> DataFrame:
        return xlsx.files(self.spark, path, max_mb)

    def cells(self, path: str, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
        """All cells with their unit; formulas only if asked for."""
        df = xlsx.read_cells(self._books(path, options.max_file_size_mb)).withColumn("unit", unit_of(F.col("number_format")))
        df = df.withColumn("value", F.when(F.col("value_type") == "s", clean_cjk(F.col("value"))).otherwise(F.col("value")))
        df = df.withColumn("style", F.struct("fill", "borders", "bold", "italic"))
        return df if options.include_logic else df.withColumn("formula", F.lit(None).cast("string"))

    def media(self, path: str, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
        return xlsx.read_media(self._books(path, options.max_file_size_mb))

    def analysed_media(self, path: str, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
        """Media with ``visual_summary`` and ``visual_data``, if asked for: each distinct image goes to the model once an engine."""
        m = self.media(path, options).withColumns({"media_id": F.col("idx").cast("long"), "visual_summary": F.lit(None).cast("string"), "visual_data": F.lit(None).cast("string")})
        if not options.include_visual_summaries:
            return m
        if (path, options) not in self._analysed:
            m = m.withColumn("image_hash", F.sha2("bytes", 256))
            images, name = m.filter("bytes is not null").select("image_hash", "bytes"), model_name(options.model)
            said = model.summarised(images, self.client, name, SUMMARY_PROMPT, concurrency=self.concurrency).select("image_hash", F.col("content").alias("visual_summary"))
            read = model.summarised(images, self.client, name, CHART_PROMPT, concurrency=self.concurrency).filter(~F.col("content").isin(model.FAILED, model.TOO_LARGE))
            both = said.join(read.select("image_hash", F.col("content").alias("visual_data")), "image_hash", "left")
            results = m.select("file_id", "filename", "image_hash").join(both, "image_hash").drop("image_hash")
            self._analysed[path, options] = checkpointed(pictures.with_results(m.drop("image_hash"), results))
        return self._analysed[path, options]

    def _stored(self) -> DataFrame | None:
        if not self.cache_path:
            return None
        try:
            return self.spark.read.parquet(self.cache_path)
        except Exception:  # nothing kept yet
            return None

    def extract_structured_data(self, path: str, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
        """file_id, sheet_name, data, error, raw_data; answers are appended to the cache."""
        c = self.cells(path, options).filter("error is null")
        names = c.groupBy("file_id", "sheet_idx").agg(F.first("sheet_name").alias("sheet_name"))
        # members in column order, values of their types
        name = F.regexp_extract(F.to_json(F.struct(F.col("header").alias("h"))), r'(?s)^\{"h":(.*)\}$', 1)
        pairs = grid.simple_rows(c).withColumn("p", F.concat(name, F.lit(": "), "json"))
        rows = pairs.groupBy("file_id", "sheet_idx", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "p"))).alias("m"))
        rows = rows.withColumn("j", F.concat(F.lit("{"), F.array_join("m.p", ", "), F.lit("}")))
        simple = rows.groupBy("file_id", "sheet_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "j"))).alias("r"))
        simple = simple.select("file_id", "sheet_idx", F.concat(F.lit("["), F.array_join(F.col("r.j"), ", "), F.lit("]")).alias("simple_json"))
        m = self.analysed_media(path, options) if options.include_visual_summaries else None
        html = grid.html_tables(c, anchors=m).drop("part_no")
        if m is not None:
            html = pictures.with_insights(html, m)
        sheets = names.join(html, ["file_id", "sheet_idx"]).join(grid.simple_sheets(c), ["file_id", "sheet_idx"]).join(simple, ["file_id", "sheet_idx"], "left")
        out = model.extracted(sheets, self.client, model_name(options.model), options.system_prompt, self._stored() if options.use_cache else None, self.concurrency, notes=LOGIC_NOTES if options.include_logic else "")
        if self.cache_path and options.use_cache:
            out = out.persist()
            new = out.filter("cache_key is not null and error is null").select("cache_key", "content", F.current_timestamp().alias("ts"), F.current_timestamp().alias("loaded_at"))
            stored = self._stored()
            (new if stored is None else new.join(stored.select("cache_key"), "cache_key", "left_anti")).write.mode("append").parquet(self.cache_path)
        return out

    def sheet_markdown(self, path: str, options: ExtractionOptions = ExtractionOptions(), list_format: str = "table") -> DataFrame:
        """file_id, source_file, sheet_name, markdown of every sheet with data."""
        source = self.cells(path, options).filter("error is null").select("file_id", "source_file").distinct()
        md = self.extract_structured_data(path, options).filter("data is not null").join(source, "file_id")
        return md.select("file_id", "source_file", "sheet_name", F.concat(F.lit("# "), "sheet_name", F.lit("\n\n"), markdown.markdown(F.col("data"), list_format)).alias("markdown"))

    def extract_rag_chunks(self, path: str, options: ExtractionOptions = ExtractionOptions(), rag: RagOptions | None = None, extraction_date: str = "") -> DataFrame:
        """(file_id, content, metadata) of every sheet."""
        rag = rag or RagOptions()
        c = self.cells(path, options).filter("error is null")
        md = self.sheet_markdown(path, options, rag.list_format)
        return chunks.contextual_chunks(md, c, self.media(path, options), extraction_date, rag.max_chunk_chars, rag.chunk_overlap_lines, rag.include_coordinates, options.include_logic and rag.include_logic_annotations, rag.output_format == "yaml_frontmatter")

    def extract_docx(self, path: str, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
        """file_id, docx."""
        c = self.cells(path, options).filter("error is null")
        m = self.analysed_media(path, options).filter("bytes is not null")
        return documents.docx_reports(self.extract_structured_data(path, options), c, m)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Workbooks to structured data, chunks or documents")
    p.add_argument("input")
    for name in ("--model", "--api-key", "--base-url", "--system-prompt"):
        p.add_argument(name)
    p.add_argument("--timeout", type=float, default=600)
    p.add_argument("--rpm", type=int)
    p.add_argument("--output-dir", default="output")
    p.add_argument("--rag-format", choices=["markdown", "yaml_frontmatter", "jsonl", "docx"], default="markdown")
    p.add_argument("--max-chunk-chars", type=int, default=1000)
    p.add_argument("--chunk-overlap-lines", type=int, default=2)
    p.add_argument("--dpi", type=int, default=150)
    for flag in ("--rag", "--docx", "--no-vision", "--no-coordinates", "--no-logic-annotations", "--include-logic", "--visual-summaries", "--verbose"):
        p.add_argument(flag, action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client: model.Client | None = None) -> int:
    """``spark-submit`` entry; documents first, then chunks, else structured data. An error ends with 1."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sheetweave").getOrCreate()
    opt = ExtractionOptions(a.model, a.system_prompt or DEFAULT_PROMPT, a.visual_summaries or not a.no_vision, not a.no_vision, a.include_logic, a.dpi)
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "WARN")
    e = Engine(spark, client, os.path.join(a.output_dir, "cache"), a.rpm, a.base_url, a.api_key, a.timeout)
    stem = lambda df: df.withColumn("stem", F.regexp_replace("source_file", r"\.xlsx$", ""))
    try:
        refused = [r.path for r in xlsx.oversized(spark, a.input, opt.max_file_size_mb).select("path").limit(20).collect()]
        if refused:
            raise ValueError(f"files beyond {opt.max_file_size_mb} MB: {refused}")
        if a.docx or a.rag and a.rag_format == "docx":
            sinks.write_files(e.extract_docx(a.input, opt), a.output_dir, ["file_id"], "docx", ".docx")
        elif a.rag:
            rag = RagOptions("kv", a.rag_format, a.max_chunk_chars, a.chunk_overlap_lines, not a.no_coordinates, not a.no_logic_annotations)
            parts = e.extract_rag_chunks(a.input, opt, rag).persist()
            md = e.sheet_markdown(a.input, opt).persist()
            if a.rag_format == "jsonl":
                sinks.write_jsonl(parts, os.path.join(a.output_dir, "chunks"))
            elif a.rag_format == "markdown":
                sinks.write_files(stem(md).withColumn("folder", F.concat("stem", F.lit("_rag"))), a.output_dir, ["folder", "sheet_name"], "markdown", ".md")
            else:
                own = stem(parts.withColumn("source_file", F.col("metadata.source_file"))).withColumn("folder", F.concat("stem", F.lit("_rag")))
                own = own.withColumn("name", F.concat("metadata.sheet_name", F.lit("_chunk_"), F.col("metadata.chunk_index").cast("string")))
                sinks.write_files(own, a.output_dir, ["folder", "name"], "content", ".md")
            sinks.write_files(stem(sinks.rag_index(parts, md)).withColumn("name", F.concat("stem", F.lit("_rag"))), a.output_dir, ["name"], "index", ".json")
        else:
            source = e.cells(a.input, opt).filter("error is null").select("file_id", "source_file").distinct()
            found = e.extract_structured_data(a.input, opt).join(source, "file_id")
            sinks.write_files(stem(sinks.file_results(found)).withColumn("name", F.concat("stem", F.lit("_result"))), a.output_dir, ["name"], "result", ".json")
    except Exception as x:
        print(f"error: {x}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
