"""The cube method over a cluster: flight in buckets, the unresolved merge upward."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut, parallelism, seed_of
from palimpsest.llm.cube import flight, land

#: Units that one task walks at a time.
BUCKET = 50_000


def balanced_sample(
    units: DataFrame,
    group: Sequence[str],
    key: str,
    pi: str,
    balance: Sequence[str],
    size: str,
    seed: int = 0,
    bucket: int = BUCKET,
) -> DataFrame:
    """Draw each unit of a group with its probability, balanced on ``balance``.

    units: one row for each unit with the columns ``group``, ``key`` (unique in
    its group), ``pi`` (0 to 1), ``balance`` (numbers, the most important first)
    and ``size`` (units of its group). Returns group and key of the drawn units.

    Units are hashed into buckets of about ``bucket`` units, so a group of any
    size is shared among tasks. The flight leaves at most one unit for each
    balancing column in a bucket; those meet in buckets of the next level, up to
    one bucket a group, where the landing resolves the rest. Rows with a null
    or zero ``pi`` aren't drawn, rows with 1 or more are.
    """
    group, balance = list(group), list(balance)
    kept = units.where(F.col(pi) > 0).select(
        *group,
        F.col(key).alias("_key"),
        F.least(F.col(pi).cast("double"), F.lit(1.0)).alias("_pi"),
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.least(F.col(pi).cast("double"), F.lit(1.0))).alias(f"_x{i}") for i, c in enumerate(balance)],
        F.greatest(F.ceil(F.col(size) / bucket), F.lit(1)).cast("long").alias("_of"),
    )
    sure = kept.where("_pi >= 1").select(*group, "_key")
    # Hash with another start than Spark's own shuffles, else buckets and partitions would coincide.
    open_ = kept.where("_pi < 1").withColumn("_salt", F.expr(f"pmod(xxhash64(_key, {seed}L), _of)"))
    schema = T.StructType([open_.schema[c] for c in open_.columns])
    xs = [f"_x{i}" for i in range(len(balance))]
    fan = max(2, bucket // max(1, len(xs)))

    def walk(final: bool):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_key", kind="stable").reset_index(drop=True)
            rng = np.random.default_rng(seed_of(seed, final, *[pdf[c].iloc[0] for c in group], pdf["_salt"].iloc[0], len(pdf)))
            order = rng.permutation(len(pdf))
            a = pdf[xs].to_numpy(float)[order]  # over the first probabilities, at every level
            p = flight(pdf["_pi"].to_numpy()[order], a, rng)
            if final:
                p = land(p, a, rng)
            pdf = pdf.iloc[order].assign(_pi=p)
            return pdf[pdf["_pi"] > 0]

        return of

    top = 1
    if (most := open_.agg(F.max("_of")).first()[0]) is not None:
        top = most
    drawn = []
    tasks = parallelism(units.sparkSession)
    while top > 1:
        # A given number of partitions isn't merged at run time, as few bytes make much work here.
        level = cut(open_.repartition(tasks, *group, "_salt").groupBy(*group, "_salt").applyInPandas(walk(False), schema))
        drawn.append(level.where("_pi >= 1").select(*group, "_key"))
        open_ = level.where("_pi < 1").withColumn("_salt", F.floor(F.col("_salt") / fan)).withColumn("_of", F.ceil(F.col("_of") / fan))
        top = -(-top // fan)
    last = open_.withColumn("_salt", F.lit(0).cast("long")).repartition(tasks, *group, "_salt").groupBy(*group, "_salt").applyInPandas(walk(True), schema)
    result = last.select(*group, "_key")
    for part in [sure, *drawn]:
        result = result.unionByName(part)
    return result.withColumnRenamed("_key", key)
