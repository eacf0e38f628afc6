"""Ranks and shares over a whole table without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of an order key by which rows are shared out before they are ranked.
PREFIX = 3


def hash_order(seed: int, *keys: Column) -> Column:
    """A shuffled order of rows, the same in every run: the MD5 of a seed and the row's keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def global_rank(rows: DataFrame, order: Column, *ties: Column, name: str = "rank", prefix: int = PREFIX) -> DataFrame:
    """Rows with their rank, from 1, by a hexadecimal order key and then ``ties``.

    Rows are counted by the key's first digits; a bucket's rows are ranked among
    themselves and lifted by the rows of the buckets before. Only that table of
    at most 16 ** prefix counts is seen as a whole. Null keys rank last.
    """
    keyed = rows.withColumn("__order", order)
    bucket = F.coalesce(F.substring("__order", 1, prefix), F.lit("~"))
    counts = keyed.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__bucket", before.alias("__before"))
    w = Window.partitionBy("__bucket").orderBy(F.col("__order").asc_nulls_last(), *ties)
    ranked = keyed.withColumn("__bucket", bucket).withColumn("__at", F.row_number().over(w))
    return ranked.join(F.broadcast(offsets), "__bucket").withColumn(name, F.col("__at") + F.col("__before")).drop("__bucket", "__at", "__before", "__order")


def near_equal_parts(rows: DataFrame, parts: int, order: Column, *ties: Column, name: str = "part") -> DataFrame:
    """Rows shared out over ``parts`` numbers from 1, sizes differing by at most one, the first ones larger."""
    total = rows.agg(F.count("*").alias("__total"))
    ranked = global_rank(rows, order, *ties, name="__rank").crossJoin(F.broadcast(total))  # one row
    small, more = F.floor(F.col("__total") / parts), F.col("__total") % parts
    edge = more * (small + 1)
    part = F.when(F.col("__rank") <= edge, F.floor((F.col("__rank") - 1) / (small + 1)) + 1).otherwise(more + F.floor((F.col("__rank") - 1 - edge) / F.greatest(small, F.lit(1))) + 1)
    return ranked.withColumn(name, part.cast("int")).drop("__rank", "__total")


def shard(key: Column, shards: int) -> Column:
    """The shard of a key: the first eight hexadecimal digits of its MD5 modulo the shards; null for null."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % shards


def top_per_group(rows: DataFrame, group: list[str], most: int, *order: Column | str, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group by ``order``, with their rank from 1.

    Rows are ranked within their group and input split first, which leaves at
    most ``most`` of each; only those meet. So a group of any size is shared
    among tasks, and its rows are sorted in one task only where they are few.
    """
    split = rows.withColumn("__split", F.spark_partition_id())
    local = Window.partitionBy(*group, "__split").orderBy(*order)
    few = split.withColumn("__at", F.row_number().over(local)).where(F.col("__at") <= most).drop("__at", "__split")
    return few.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)
