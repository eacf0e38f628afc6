"""Writers of the file formats that benchmark results go to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(rows: DataFrame, path: str, *parts: str, mode: str = "overwrite") -> None:
    """A JSON object a line, null fields kept, in a folder for each value of ``parts``.

    The commit protocol makes the write whole or void.
    """
    writer = rows.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*parts) if parts else writer).json(path)


def whole_file(spark: SparkSession, text: str, path: str) -> None:
    """Write one small text as the file ``path``, whole or not at all: beside it first, then renamed over what is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(beside, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, where, options)


def json_arrays(rows: DataFrame, path: str, files: int) -> None:
    """JSON arrays in ``files`` files, null fields kept; each file is one task's work and should be small."""
    one = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_row")
    parts = rows.select(F.expr(f"pmod(xxhash64(struct(*)), {files})").alias("_part"), one).groupBy("_part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("_row"), ",\n"), F.lit("]")).alias("value"))
    parts.repartition(files, "_part").sortWithinPartitions("_part").select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def fixed(value: Column, digits: int = 6, missing: str = "") -> Column:
    """A number as text with fixed decimals; null and NaN as ``missing``."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), missing).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def csv(rows: DataFrame, path: str, digits: int = 6, missing: str = "", mode: str = "overwrite") -> None:
    """A CSV with a header, fractions with fixed decimals, null and NaN as ``missing``."""
    columns = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = fixed(c, digits, missing)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        else:
            c = F.coalesce(c.cast("string"), F.lit(missing))
        columns.append(c.alias(f.name))
    rows.select(*columns).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def long_form(panels: dict[str, DataFrame]) -> DataFrame:
    """Several panels as one table with a column ``panel``; columns that one lacks are null."""
    result = None
    for name, p in panels.items():
        part = p.withColumn("panel", F.lit(name))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't in the Parquet table at ``path`` yet; the number appended.

    Rows come in once for each key. A write that fails leaves the table as it
    was, so the call can be repeated.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    fresh = rows.dropDuplicates([key])
    if there:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n or not there:
            fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n


def progress(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: total, completed and pending keys, and whether all are completed."""
    total = rows.select(key).distinct()
    both = total.join(done.select(key, F.lit(1).alias("_done")).distinct(), key, "left")
    return both.agg(F.count("*").alias("total"), F.count("_done").alias("completed")).withColumn("pending", F.col("total") - F.col("completed")).withColumn("done", F.col("pending") == 0)
