"""Results as they come in: resumable ingestion, windows, sessions, histories."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.lineage import cut


def read_jsonl(spark: SparkSession, folder: str, schema: str | T.StructType, files_each: int = 1_000) -> DataFrame:
    """A stream of JSON lines from the files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet table, a folder or a single file, as written so far."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    # A stream's source is a folder; the file is picked out of its own.
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def once_each(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; repetitions are known for as long as the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def hopping_counts(stream: DataFrame, time: str, width: str, step: str, delay: str, *keys: str) -> DataFrame:
    """(start, end, *keys, n, total) of overlapping windows; rows later than the watermark are left out."""
    by = stream.withWatermark(time, delay).groupBy(F.window(time, width, step), *keys)
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, delay: str, *keys: str) -> DataFrame:
    """(start, end, *keys, n): stretches of a key's rows without a pause longer than ``gap``."""
    by = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys)
    return by.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def histories(stream: DataFrame, key: str, order: str, value: str, most: int = 5) -> DataFrame:
    """(key, order, value, history): each row with up to ``most`` values that came before it for its key.

    Rows of a micro-batch are taken in order; later batches go on from the
    state. The state of a key is its last values only.
    """
    kinds = stream.schema
    out = T.StructType([T.StructField(key, kinds[key].dataType), T.StructField(order, kinds[order].dataType), T.StructField(value, kinds[value].dataType), T.StructField("history", T.ArrayType(kinds[value].dataType))])
    state_type = T.StructType([T.StructField("last", T.ArrayType(kinds[value].dataType))])

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        before = []
        for v in rows[value]:
            before.append(list(last))
            if v is not None and str(v).strip():
                last = [*last, v][-most:]
        state.update((last,))
        yield pd.DataFrame({key: rows[key], order: rows[order], value: rows[value], "history": before})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, target: str, state: str, key: str, mode: str = "append"):
    """Write each micro-batch as its own part of a table, without the keys that earlier parts have; a query handle.

    The keys seen are the stream's state, so a micro-batch reads no earlier
    part. Where the table is there but not the state, as after a move, its keys
    are read once, at the start. A batch that is repeated after a failure
    overwrites its own part, so every row is there once. Rows with a null or
    empty ``key`` are failures and not kept.
    """
    spark = stream.sparkSession
    good = stream.where(F.length(F.col(key).cast("string")) > 0)
    moved = _exists(spark, target) and not _exists(spark, state)
    if moved:
        good = good.join(cut(spark.read.parquet(target).select(key).distinct()), key, "left_anti")
    prefix = uuid.uuid4().hex[:8] if moved else "0"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={prefix}-{number}")

    return good.dropDuplicates([key]).writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run_to_table(stream: DataFrame, target: str, state: str, mode: str = "append") -> None:
    """Run a stream over all that is there now and write its last result as a table.

    In append mode each micro-batch is a part; in complete mode the last one
    stands for all.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number if mode == 'append' else 0}")

    handle = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    handle.awaitTermination()
