"""Queries that run as streams over all rows there are and give their result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.lineage import new_folder
from palimpsest.plans.registry import query
from palimpsest.streaming import results as R


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    place = new_folder(spark, "streams")
    R.run_to_table(stream, f"{place}/rows", f"{place}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{place}/rows").select(*stream.columns)


@query("""
WITH w AS (SELECT ts, event_type, value, unnest([0, 1]) AS k FROM events), x AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS start, event_type, value FROM w)
SELECT start, start + INTERVAL 12 HOURS AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM x GROUP BY ALL
""")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    stream = R.read_table(spark, f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _run(spark, R.hopping_counts(stream, "ts", "12 hours", "6 hours", "1 day", "event_type"), "complete")
    return rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOURS THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    stream = R.read_table(spark, f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _run(spark, R.sessions(stream, "ts", "8 hours", "1 day", "user_id"), "complete")
    return rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    events = R.read_table(spark, f"{folder}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.unionByName(events)
    rows = _run(spark, R.once_each(twice, ["event_id"], "ts", "30 days"), "append")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, coalesce(string_agg(event_type, '>') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM events
""")
def stream_histories(spark: SparkSession, folder: str) -> DataFrame:
    stream = R.read_table(spark, f"{folder}/events.parquet")
    rows = _run(spark, R.histories(stream, "user_id", "event_id", "event_type"), "append")
    return rows.select("event_id", F.array_join("history", ">").alias("history"))
