"""A watched folder of workbooks as a stream: every file is processed once, however often the job restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetweave.sources.xlsx import MAX_MB, read_cells


def watch(spark: SparkSession, path: str, max_mb: int = MAX_MB, files_per_batch: int = 100) -> DataFrame:
    """Stream of new workbook files: file_id, source_file, content."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", files_per_batch).load(path)
    s = s.filter(F.col("length") <= max_mb * 1024 * 1024)
    return s.select(F.sha2("content", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")


def run(spark: SparkSession, path: str, out: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Append the cells of new files to ``out``; a file that can't be read becomes an error row and doesn't stop the stream.

    The batch number partitions the output and a batch replaces its own partition, so a repeated batch writes nothing twice.
    """

    def batch(df: DataFrame, n: int) -> None:
        cells = read_cells(df)
        cells.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if then:
            then(df.sparkSession.read.parquet(f"{out}/batch={n}"), n)

    w = watch(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
