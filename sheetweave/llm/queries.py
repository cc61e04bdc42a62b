"""Queries of the training-text operators, over their whole tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm import leaks, lookalike, mojibake, packing, pairs, split
from sheetweave.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells that look like a term but are written with other characters."""
    return lookalike.meets(table(spark, d, "cells").select("cell_id", "value"), table(spark, d, "terms"))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every cell's text in its one consistent spelling."""
    return lookalike.normalised(table(spark, d, "cells").select("cell_id", "value"), table(spark, d, "terms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items beyond the limit of their option."""
    return split.oversized(table(spark, d, "rag_items"), table(spark, d, "rag_options"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All items as ordered pieces."""
    return split.split_items(table(spark, d, "rag_items"), table(spark, d, "rag_options"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective prompt and response pairs with their defect."""
    return pairs.defects(table(spark, d, "llm_cache"), table(spark, d, "vlm_cache"), table(spark, d, "extraction_results"), table(spark, d, "llm_requests"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container and position of each document or piece, for each target."""
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are."""
    return packing.fill_report(p6_packed(spark, d), table(spark, d, "pack_targets"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a test item."""
    return _leaks(spark, d).filter("leaked").select("doc_id", "item_id")


def p7_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Every aligned document and item with score, share of the item and longest exact run."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with wrongly decoded text."""
    return mojibake.Garbled(table(spark, d, "documents")).found().select(F.col("id").alias("doc_id"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those documents with the swap they went through and their original text."""
    return mojibake.Garbled(table(spark, d, "documents")).restored().withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p2_pieces, p3_found, p6_packed, p6_fill, p7_found, p7_alignments, p8_found, p8_restored)}

ORACLES = {
    "p2_found": """
        SELECT DISTINCT item_no FROM rag_items LEFT JOIN rag_options USING (option_id)
        WHERE length(content) > coalesce(max_chunk_chars, 1000)
    """,
}
