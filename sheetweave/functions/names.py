"""File and sheet names."""

from __future__ import annotations

import os
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(text: str | None) -> str:
    """A name that is safe as a file name; ``unnamed`` where nothing is left."""
    t = unicodedata.normalize("NFKD", text or "").replace(" ", "_")
    t = re.sub(r"[^\w.\-]", "_", t).strip("._")
    t = re.sub(r"\.{2,}", ".", re.sub(r"_{2,}", "_", t))
    return t or "unnamed"


def _slow(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(safe_name)

    return run(c)


def safe_name_column(c: Column) -> Column:
    """``safe_name`` of a column: ASCII names in the JVM, the rest (which needs a compatibility decomposition) in Arrow batches."""
    a = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r"[^A-Za-z0-9_.\-]", "_")
    a = F.regexp_replace(F.regexp_replace(F.regexp_replace(a, r"^[._]+|[._]+$", ""), "_{2,}", "_"), r"\.{2,}", ".")
    native = F.when(a == "", "unnamed").otherwise(a)
    return F.when(F.coalesce(c, F.lit("")) == "", "unnamed").when(c.rlike(r"^[\x00-\x7f]*$"), native).otherwise(_slow(c))


def sheet_of_media(filename: Column) -> Column:
    """Sheet a media file name was made from: the part before ``_img_``, else before the first ``_``."""
    return F.when(filename.contains("_img_"), F.substring_index(filename, "_img_", 1)).otherwise(F.substring_index(filename, "_", 1))


def model_name(given: str | None = None) -> str:
    """The model to use: the given one, or the environment's."""
    return given or os.environ.get("LLM_MODEL") or os.environ.get("GEMINI_MODEL") or "gemini-1.5-flash"
