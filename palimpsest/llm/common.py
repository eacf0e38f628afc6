"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from palimpsest.lineage import cut

__all__ = ["cut", "parallelism", "seed_of", "spread", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks that Python-heavy stages should have: a few for each core."""
    return max(8, 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, always: bool = False) -> DataFrame:
    """Spread rows over all cores before a Python-heavy stage.

    A scan of few, small files gives few tasks, which would do all the Python
    work; its rows are shuffled. A scan that has enough splits is left as it is.
    With ``always`` the rows are shuffled, as for a few rows behind a join or
    filter, whose splits aren't known beforehand.
    """
    n = parallelism(df.sparkSession)
    if not always and df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n)


def seed_of(*parts: object) -> int:
    """A seed that depends on the parts alone, so a lost task repeats alike."""
    return int.from_bytes(hashlib.md5("\x1f".join(map(str, parts)).encode()).digest()[:8], "big")
