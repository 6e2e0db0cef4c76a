"""Readers for the parquet test tables (one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Tables whose rows carry long texts: per-row work dominates them.
TEXT_TABLES = {"documents", "pages", "conversations"}
SPREAD = "spark.prefeval.read.partitions"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the parquet scan.

    Splits come from the files (``spark.sql.files.maxPartitionBytes``). Files
    of a single row group cannot be split; a session that reads such files may
    set ``spark.prefeval.read.partitions`` to deal text tables out anew."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None) if name in TEXT_TABLES else None
    return df.repartition(int(spread)) if spread else df
