"""Markdown cut into sections and overlapping size-bounded chunks, with numbering, provenance and front matter.

Splitting, folding and numbering are higher-order expressions; a text never leaves the JVM unless its front matter needs YAML
quoting. The fold holds one section at a time.

Defined results: null text has no sections; empty sections are dropped; a line longer than the budget makes a chunk of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.text import lines, strip
from sheetweave.operators import match

MAX_CHARS, OVERLAP = 1000, 2
GENERAL = "全般"


def with_sections(df: DataFrame, text: str, contextual: bool = True) -> DataFrame:
    """A row per section (cut before each first-level heading): section_no (from 0), section (its heading), body."""
    parts = F.filter(F.transform(F.split(F.concat(F.lit("\n"), F.col(text)), "\n(?=# )"), strip), lambda s: s != "")
    name = F.regexp_extract("body", r"^#+\s+([^\n\r]*)", 1) if contextual else F.regexp_extract("body", r"^#\s+([^\n\r]*)", 1)
    keep = [c for c in df.columns if c not in ("section_no", "section", "body")]
    out = df.select(*keep, F.posexplode(parts).alias("section_no", "body"))
    return out.withColumn("section", F.when(name == "", GENERAL).otherwise(name) if contextual else name)


def fold_chunks(text: Column, limit: Column | int = MAX_CHARS, overlap: Column | int = OVERLAP) -> Column:
    """Array of chunks: lines are taken until the next one (its end included) would pass the limit; the last ``overlap`` lines are repeated."""
    limit, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (limit, overlap))
    none = F.array().cast("array<string>")
    size = lambda ls: F.aggregate(ls, F.lit(0), lambda n, x: n + F.length(x) + 1)

    def step(a: Column, line: Column) -> Column:
        full = (a["n"] + F.length(line) + 1 > limit) & (F.size(a["cur"]) > 0)
        kept = F.when((overlap > 0) & (F.size(a["cur"]) >= overlap), F.slice(a["cur"], -F.greatest(overlap, F.lit(1)), F.greatest(overlap, F.lit(1)))).otherwise(none)
        return F.when(full, F.struct(F.concat(a["done"], F.array(F.array_join(a["cur"], "\n"))).alias("done"), F.concat(kept, F.array(line)).alias("cur"), (size(kept) + F.length(line) + 1).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["cur"], F.array(line)).alias("cur"), (a["n"] + F.length(line) + 1).alias("n"))
        )

    start = F.struct(none.alias("done"), none.alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(lines(text), start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(F.array_join(a["cur"], "\n")))).otherwise(a["done"]))


def chunked(df: DataFrame, keys: list[str], text: str = "body", limit: Column | int = MAX_CHARS, overlap: Column | int = OVERLAP) -> DataFrame:
    """A row per chunk of each section, numbered over all sections of ``keys``: chunk_index (from 1), total_chunks, content.

    The numbers are made inside one row per key, so no window over all chunks is needed.
    """
    rest = [c for c in df.columns if c not in (*keys, text, "section_no")]
    per = df.withColumn("_c", fold_chunks(F.col(text), limit, overlap))
    item = F.transform("_c", lambda c: F.struct(*[F.col(x) for x in ["section_no", *rest]], c.alias("content")))
    all_of = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("section_no").alias("k"), item.alias("i")))).alias("s"))
    flat = all_of.select(*keys, F.flatten("s.i").alias("i"))
    out = flat.select(*keys, F.size("i").alias("total_chunks"), F.posexplode("i").alias("p", "x"))
    return out.select(*keys, "x.section_no", *[F.col(f"x.{c}").alias(c) for c in rest], (F.col("p") + 1).alias("chunk_index"), "total_chunks", F.col("x.content").alias("content"))


def section_chunks(df: DataFrame, text: str, source_id: str) -> DataFrame:
    """One chunk per section with its name and source, the plain form."""
    return with_sections(df, text, contextual=False).select(F.col("body").alias("content"), "section", F.col(source_id).cast("string").alias("source_id"), "section_no")


def front_matter(meta: Column) -> Column:
    """YAML head of a chunk from its metadata struct: sorted keys, nulls and empty strings left out."""

    @F.pandas_udf("string")
    def _yaml(batch: pd.DataFrame) -> pd.Series:
        import yaml

        out = []
        for row in batch.to_dict("records"):
            d = {}
            for k, v in row.items():
                if v is None or v == "" or v != v:
                    continue
                d[k] = bool(v) if k.startswith("has_") else int(v) if k in ("chunk_index", "total_chunks") else v
            out.append("---\n" + yaml.dump(d, allow_unicode=True, default_flow_style=False) + "---\n\n")
        return pd.Series(out)

    return _yaml(meta)


def contextual_chunks(docs: DataFrame, cells: DataFrame, media: DataFrame, extraction_date: str, limit: int = MAX_CHARS, overlap: int = OVERLAP, coordinates: bool = True, notes: bool = True, yaml_head: bool = False) -> DataFrame:
    """Chunks with provenance: (content, metadata) for documents (file_id, sheet_name, source_file, markdown).

    A section's coordinates and flags hold for all its chunks; annotations of derived values follow its text.
    """
    keys = match.KEYS
    sec = with_sections(docs.select(*keys, "source_file", "markdown"), "markdown")
    facts = match.section_facts(match.value_matches(sec, cells), notes)
    flags = match.media_flags(sec, facts, media).withColumn("has_media", F.lit(True))
    df = sec.join(facts, [*keys, "section_no"], "left").join(flags, [*keys, "section_no"], "left")
    extra = F.coalesce("annotations", F.lit(""))
    body = F.when(extra != "", F.concat(F.col("body"), F.lit("\n\n"), extra)).otherwise(F.col("body"))
    place = F.coalesce("coordinates", F.lit("")) if coordinates else F.lit("")
    df = df.select(*keys, "source_file", "section_no", "section", body.alias("body"), place.alias("coordinates"), F.coalesce("has_formulas", F.lit(False)).alias("has_formulas"), F.coalesce("has_media", F.lit(False)).alias("has_media"))
    c = chunked(df, keys, "body", limit, overlap)
    meta = F.struct("source_file", "sheet_name", "section", "coordinates", "has_formulas", "has_media", F.lit(extraction_date).alias("extraction_date"), "chunk_index", "total_chunks")
    content = F.concat(front_matter(meta), F.col("content")) if yaml_head else F.col("content")
    return c.select("file_id", content.alias("content"), meta.alias("metadata"))
