"""Where results go: JSON lines, JSON, Markdown and DOCX files, stored caches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.names import safe_name


def jsonl_line(content: Column, metadata: Column) -> Column:
    """One chunk as a JSON line; missing parts as ``""`` and ``{}``, nulls kept."""
    return F.concat(F.lit('{"content": '), F.regexp_extract(F.to_json(F.struct(F.coalesce(content, F.lit("")).alias("c"))), r'(?s)^\{"c":(.*)\}$', 1), F.lit(', "metadata": '), F.coalesce(F.to_json(metadata, {"ignoreNullFields": "false"}), F.lit("{}")), F.lit("}"))


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """Chunks (content, metadata) as JSON lines."""
    chunks.select(jsonl_line(F.col("content"), F.col("metadata"))).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per row, nulls kept."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def rag_index(chunks: DataFrame, markdown: DataFrame) -> DataFrame:
    """file_id, source_file, index: chunk count and Markdown of each sheet of a file as one JSON object."""
    n = chunks.groupBy("file_id", F.col("metadata.sheet_name").alias("sheet_name")).agg(F.count("*").alias("n"))
    per = markdown.join(n, ["file_id", "sheet_name"], "left").select("file_id", "source_file", "sheet_name", F.struct(F.coalesce("n", F.lit(0)).alias("chunks"), "markdown").alias("x"))
    one = F.map_from_entries(F.array_sort(F.collect_list(F.struct("sheet_name", "x"))))
    return per.groupBy("file_id", "source_file").agg(F.to_json(one, {"pretty": "true"}).alias("index"))


def file_results(results: DataFrame) -> DataFrame:
    """file_id, source_file, result: the sheets of a file as one JSON object (members of a sheet keep their order)."""
    text = F.concat(F.to_json(F.struct(F.col("sheet_name").alias("n"))), F.lit(""))
    name = F.regexp_extract(text, r'(?s)^\{"n":(.*)\}$', 1)
    own = F.concat(F.lit("    "), name, F.lit(": "), F.coalesce("data", F.to_json(F.struct("error"))))
    g = results.groupBy("file_id", "source_file").agg(F.array_sort(F.collect_list(F.struct("sheet_name", own.alias("t")))).alias("s"))
    return g.select("file_id", "source_file", F.concat(F.lit('{\n  "sheets": {\n'), F.array_join("s.t", ",\n"), F.lit("\n  }\n}")).alias("result"))


def write_files(df: DataFrame, folder: str, names: list[str], content: str, suffix: str) -> None:
    """Each row's text or bytes as a file of its own under the folder of its first names, all made safe, in any file system that
    the executors reach by its URI. Written where the rows are; a file appears whole, whichever attempt ends first."""

    def save(rows) -> None:
        from pyarrow import fs

        disk, base = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        for r in rows:
            data = r[content]
            if data is None:
                continue
            at = "/".join([base, *(safe_name(str(r[n])) for n in names)]) + suffix
            disk.create_dir(at.rsplit("/", 1)[0], recursive=True)
            part = f"{at}.{uuid.uuid4().hex}.part"
            with disk.open_output_stream(part) as f:
                f.write(bytes(data) if isinstance(data, (bytes, bytearray)) else data.encode())
            disk.move(part, at)

    df.select(*names, content).foreachPartition(save)
