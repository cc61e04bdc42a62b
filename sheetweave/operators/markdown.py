"""Structured results as Markdown.

Arbitrary JSON is walked in Arrow batches, since its order and Python's rendering of values count; flat tables of known columns
have a way of their own in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.text import md_escape


class Writer:
    """Renders one JSON value. ``list_format``: ``kv`` or ``table`` for lists of objects."""

    def __init__(self, list_format: str = "table") -> None:
        self.table = list_format == "table"

    def render(self, x: object, level: int = 1) -> str:
        if isinstance(x, dict):
            if level == 1 and "media" in x:
                return self.media(x["media"])
            if level == 1 and isinstance(x.get("sheets"), dict):
                parts = ((name, self.render(v, 2)) for name, v in x["sheets"].items())
                return "\n\n".join(f"# {name}\n\n{text}" for name, text in parts if text not in ("", "None"))
            return self.members(x, level)
        if isinstance(x, list):
            return self.items(x, level)
        return str(x)

    def members(self, x: dict, level: int) -> str:
        out = []
        for k, v in x.items():
            if k.startswith("_"):
                continue
            if k == "media" and isinstance(v, list):
                out.append(self.media(v))
            elif isinstance(v, (dict, list)):
                depth = level + 1 if level == 1 else level
                if v and (text := self.render(v, depth + 1)) not in ("", "None"):
                    out.append(f"{'#' * depth} {k}\n{text}")
            elif (text := str(v)) not in ("", "None"):
                out.append(f"- **{k}**: {text}")
        return "\n".join(t for t in out if t)

    def items(self, x: list, level: int) -> str:
        if not x:
            return ""
        if isinstance(x[0], dict):
            same = all(isinstance(r, dict) and r.keys() == x[0].keys() for r in x)
            if self.table and same:
                return self.rows(x)
            if not self.table and all(isinstance(r, dict) for r in x):
                return "\n".join("- " + ", ".join(f"{k}: {v}" for k, v in r.items()) for r in x)
        return "\n".join(f"- {self.render(v, level)}" for v in x)

    def rows(self, x: list[dict]) -> str:
        heads = list(x[0])
        cell = lambda v: str(v).replace("|", "\\|").replace("\n", "<br>")
        line = lambda cells: "| " + " | ".join(cells) + " |"
        return "\n".join([line(map(cell, heads)), line(["---"] * len(heads)), *(line([cell(r.get(h, "")) for h in heads]) for r in x)])

    def media(self, items: list) -> str:
        out = ["## 関連メディア"]
        for m in items or []:
            if isinstance(m, dict) and m.get("filename"):
                out.append(f"![画像](media/{m['filename'].rsplit('/', 1)[-1]})")
                if s := m.get("visual_summary"):
                    out.append(s.replace("[画像概要]", "**[画像概要]**:") if s.startswith("[画像概要]") else f"**[画像概要]**: {s}")
        return "\n\n".join(out)


def markdown(c: Column, list_format: str = "table") -> Column:
    """Markdown of a JSON column; JSON that can't be read is rendered as the text it is, null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = Writer(list_format)

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return w.render(json.loads(t))
            except ValueError:
                return t

        for s in batches:
            yield s.map(one)

    return run(c)


def _line(cols: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))


def flat_table(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """A Markdown table of the columns for each key, rows in order; nulls as ``None``."""
    cells = [md_escape(F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in cols]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, _line(cells).alias("_md")))).alias("_r"))
    head = _line([F.lit(c) for c in cols]), _line([F.lit("---") for _ in cols])
    return rows.select(*keys, F.concat_ws("\n", *head, F.array_join(F.col("_r._md"), "\n")).alias("markdown"))


def flat_kv(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """A list of ``- k: v, k2: v2`` lines for each key."""
    pairs = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in cols]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.concat(F.lit("- "), F.concat_ws(", ", *pairs)).alias("_md")))).alias("_r"))
    return rows.select(*keys, F.array_join(F.col("_r._md"), "\n").alias("markdown"))


def uniform_keys(df: DataFrame, keys: list[str], order: list[str], json_col: str) -> DataFrame:
    """Whether all objects of a key have the same members as the first one, in any order."""
    names = F.array_sort(F.json_object_keys(F.col(json_col)))
    g = df.groupBy(*keys).agg(F.min_by(names, F.struct(*order)).alias("a"), F.min(names).alias("lo"), F.max(names).alias("hi"), F.count_if(names.isNull()).alias("bad"))
    return g.select(*keys, ((F.col("lo") == F.col("hi")) & (F.col("bad") == 0)).alias("uniform"), F.col("a").alias("members"))
