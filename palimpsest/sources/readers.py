"""Readers of the file formats that benchmark data comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "struct<event_id:string,time_of_year:string,category:string,description:string,psychological_note:string,caused_by_event_ids:array<string>,timestamp:string>"
STORY = f"character_name string, chronology array<struct<year:string,narrative_summary:string,events:array<{EVENT}>>>"
FACT = "struct<fact:string,fact_id:string,timestamp:string,state_repr:string,schema:string>"
MODES = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "null": "PERMISSIVE"}


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether a file's first character that isn't white space opens an array; only the head is read."""
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).first()
    return bool(head) and head["value"].lstrip("﻿ \t").startswith("[")


def records(spark: SparkSession, path: str, schema: str | T.StructType, malformed: str = "fail", array: bool | None = None) -> DataFrame:
    """Rows of a JSON array or of a JSON object a line; which of them the first character tells, unless ``array`` does.

    malformed: "fail" raises, "drop" leaves such rows out, "null" keeps them
    with nulls. Blank lines are passed over. An array is one task's work, as a
    file of it can't be split; lines are split as usual.
    """
    array = is_array(spark, path) if array is None else array
    reader = spark.read.schema(schema).option("mode", MODES[malformed])
    return (reader.option("multiLine", True) if array else reader).json(path)


def optional_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """As :func:`records`, dropping malformed rows; no rows where there is no file."""
    if not files(spark, path).take(1):
        return spark.createDataFrame([], schema)
    return records(spark, path, schema, "drop")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modified, length) of the files under a path, their contents unread; none where nothing is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        return spark.createDataFrame([], "path string, modified timestamp, length long")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return listed.select("path", F.col("modificationTime").alias("modified"), "length")


def newest(found: DataFrame, group: Column) -> DataFrame:
    """(group, path): the file modified last of each group, of equals the last by name; groups of '' are left out."""
    rows = found.select(group.alias("group"), "path", "modified").where("group <> ''")
    return rows.groupBy("group").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def path_part(pattern: str, group: int = 1) -> Column:
    """A part of the path of the file that a row comes from; '' where the pattern doesn't fit."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def score_files(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(checkpoint, stage, doc) of all checkpoint_stage_NN/stage_NN_<split>*/scores.json under a root; the first by name of several.

    doc is the file's text; checkpoints and stages come from the folders' names.
    A root without such files, or none, gives no rows.
    """
    listed = files(spark, root, "scores.json").select("path")
    if not listed.take(1):
        return spark.createDataFrame([], "checkpoint int, stage int, doc string")
    c = F.regexp_extract("path", r"checkpoint_stage_(\d+)/", 1).try_cast("int")
    s = F.regexp_extract("path", rf"/stage_(\d+)_{split}[^/]*/scores\.json$", 1).try_cast("int")
    chosen = listed.select("path", c.alias("checkpoint"), s.alias("stage")).where("checkpoint IS NOT NULL AND stage IS NOT NULL").groupBy("checkpoint", "stage").agg(F.min("path").alias("path"))
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "scores.json").option("wholetext", True).text(root).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("path"))
    plain = lambda p: F.regexp_replace(p, "^file:/+", "/")
    return texts.withColumn("path", plain(F.col("path"))).join(chosen.withColumn("path", plain(F.col("path"))), "path").select("checkpoint", "stage", "doc")


def level_files(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(level, path) of the prompt files whose names give a level from ``low`` to ``high``, in order."""
    level = F.regexp_extract("path", r"_L(\d+)_[^/]*$", 1).try_cast("int")
    return files(spark, path).select(level.alias("level"), "path").where(F.col("level").between(low, high)).orderBy("level", "path")


def story_events(stories: DataFrame) -> DataFrame:
    """(character_name, year, event fields) of stories read with STORY, in no order; null blocks and events left out."""
    blocks = stories.select("character_name", F.explode("chronology").alias("b"))
    return blocks.select("character_name", F.col("b.year").alias("year"), F.explode("b.events").alias("e")).where("e IS NOT NULL").select("character_name", "year", "e.*")


def facts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(character, pos, fact fields) of an object of lists of facts, white space squeezed.

    A fact needs a text, an id and a date; with ``strict`` one that lacks them
    raises when it is read, else it is left out.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"map<string,array<{FACT}>>").alias("m"))
    rows = whole.select(F.explode("m").alias("character", "list")).select("character", F.posexplode("list").alias("pos", "f"))
    flat = rows.select("character", "pos", *[F.trim(F.regexp_replace(F.col(f"f.{c}"), r"\s+", " ")).alias(c) for c in ("fact", "fact_id", "timestamp", "state_repr", "schema")])
    good = (F.length("fact") > 0) & (F.length("fact_id") > 0) & F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}")
    good = F.coalesce(good, F.lit(False))
    if not strict:
        return flat.where(good)
    broken = F.concat(F.lit("a fact of "), F.coalesce("character", F.lit("?")), F.lit(" lacks its text, id or date"))
    return flat.withColumn("fact", F.when(good, F.col("fact")).otherwise(F.raise_error(broken)))


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with a header; empty fields and NaN are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "NaN").csv(path)


def catalog(spark: SparkSession, path: str, schema: str | T.StructType, most: int = 100_000) -> DataFrame:
    """A small dimension table; raises above ``most`` rows, so that it may be broadcast."""
    rows = records(spark, path, schema, "fail")
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"{path} has more than {most} rows")
    return F.broadcast(rows)


def jobs(samples: DataFrame, task: str, each: int | None = None) -> DataFrame:
    """(file, sample_id, prompt, truth): the entry of ``task`` of each ladder sample, the first ``each`` of a file.

    samples: (file, sample_id, data), data an array of (Task, Prompt, GT).
    Samples without the entry or without a prompt are left out.
    """
    found = F.try_element_at(F.filter("data", lambda x: x["Task"] == task), F.lit(1))
    rows = samples.select("file", "sample_id", found.alias("x")).where(F.length(F.trim("x.Prompt")) > 0)
    flat = rows.select("file", "sample_id", F.col("x.Prompt").alias("prompt"), F.col("x.GT").alias("truth"))
    if each is None:
        return flat
    w = Window.partitionBy("file").orderBy("sample_id")
    return flat.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= each).drop("_at")
