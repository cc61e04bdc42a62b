"""Session helpers: table access, deduplicated reads and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, so that their Python workers find it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_sheetweave", None) is None:
        here = os.path.dirname(os.path.abspath(__file__))
        at = os.path.join(tempfile.mkdtemp(prefix="sheetweave-"), "sheetweave.zip")
        with zipfile.ZipFile(at, "w") as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
        sc.addPyFile(at)
        sc._sheetweave = at
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local master (tests, a laptop)
    gets a temporary folder and a cluster a folder beside its warehouse; a machine-local path is never used on a cluster.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            named = tempfile.mkdtemp(prefix="sheetweave-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return df.checkpoint()


def latest(df: DataFrame, keys: list[str], order: list[str], value_cols: list[str]) -> DataFrame:
    """The last delivered row of each key, by an aggregate with map-side combine (a hot key never reaches one task whole).

    Ties on ``order`` are broken by the values themselves, so the result doesn't depend on the partitioning. Null keys
    form one group, null order values come first.
    """
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in value_cols])
    best = df.groupBy(*keys).agg(F.max(rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in dict.fromkeys([*order, *value_cols])])
