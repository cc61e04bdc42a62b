"""Result caches as tables: the last writing of a key counts, misses are what an anti-join leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.session import latest


def current(cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Each key with its last content (by ``ts``, then arrival)."""
    return latest(cache, [key], ["ts", "loaded_at"], ["content"])


def hits(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with cached content."""
    return requests.join(current(cache, key).select(key, "content"), key)


def misses(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests without an entry in the cache."""
    return requests.join(cache.select(key), key, "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new entries; read through ``current``, later writes win. Append ``new`` to the stored table to keep it."""
    return cache.unionByName(new.withColumn("loaded_at", F.col("ts")) if "loaded_at" not in new.columns else new, allowMissingColumns=True)


def cleared(cache: DataFrame) -> DataFrame:
    """The empty cache."""
    return cache.limit(0)
