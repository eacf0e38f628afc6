"""Operators over ordered rows: gaps, chunks, windows, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.rank import hash_order


def longest_gap(events: DataFrame, group: Sequence[str], day: str, order: str) -> DataFrame:
    """The row before the longest gap between neighbours of a group, with ``gap``.

    Rows follow one another by day, ties by ``order``. The first of equally long
    gaps counts. A group of one row, or whose rows all fall on one day, gives
    its first row with the gap 0; rows with a null day come first and open no gap.
    """
    w = Window.partitionBy(*group).orderBy(day, order)
    gap = F.lead(day).over(w) - F.col(day)
    marked = events.withColumn("gap", gap).withColumn("_at", F.row_number().over(w))
    kept = [c for c in events.columns if c not in group]
    best = F.max_by(F.struct(*kept, F.coalesce("gap", F.lit(0)).alias("gap")), F.struct(F.coalesce("gap", F.lit(-1)), -F.col("_at"))).alias("_best")
    return marked.groupBy(*group).agg(best).select(*group, "_best.*")


def repeats(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Rows with ``repeated``: whether an earlier row, by ``order``, has the same keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("repeated", F.row_number().over(w) > 1)


def trailing(rows: DataFrame, group: Sequence[str], value: str, most: int, *order: str) -> DataFrame:
    """Rows whose value is neither null nor blank, with ``history``: the values of up to ``most`` such rows before."""
    told = rows.where(F.length(F.trim(value)) > 0)
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-most, -1)
    return told.withColumn("history", F.collect_list(value).over(w))


def next_gaps(rows: DataFrame, group: Sequence[str], time: str, *ties: str) -> DataFrame:
    """Rows with the days and hours to the next row of their group; null for the last and for null times, which come last."""
    w = Window.partitionBy(*group).orderBy(F.col(time).asc_nulls_last(), *ties)
    following = F.lead(time).over(w)
    seconds = F.unix_seconds(following.cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp"))
    return rows.withColumn("days_to_next", F.datediff(following, F.col(time))).withColumn("hours_to_next", F.floor(seconds / 3600))


def crowded(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Groups and values that occur more than once: (*group, value, n)."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n")).where("n > 1")


def batches(rows: DataFrame, bucket: Sequence[str], size: int, *order: str) -> DataFrame:
    """Rows with ``batch``: within its bucket, ``size`` rows in order make a batch, numbered from 0."""
    w = Window.partitionBy(*bucket).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def entity_split(rows: DataFrame, group: Sequence[str], ratio: float, seed: int, *keys: str) -> DataFrame:
    """Rows with ``part``: in each group the first round(n * ratio), at least 1 and at most n - 1, are "train".

    Rounding is half to even; the order is shuffled by hash. A group of one row
    is train.
    """
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    train = F.when(n <= 1, n).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * ratio).cast("long"))))
    at = F.row_number().over(w.orderBy(hash_order(seed, *[F.col(k) for k in keys]), *keys))
    return rows.withColumn("part", F.when(at <= train, "train").otherwise("test"))


def runs(rows: DataFrame, group: Sequence[str], value: str, *order: str) -> DataFrame:
    """(*group, value, run, length): stretches of neighbouring rows with one value, numbered from 1; nulls make stretches too."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*group, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))
