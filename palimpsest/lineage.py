"""Cutting a plan's lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure that ``checkpoint()`` has a folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local is a temporary one chosen; a cluster without it
    raises, as a folder of one machine would lose the rows of the others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, see :func:`with_checkpoints`."""
    context = spark.sparkContext
    if folder := context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not (context.master.startswith("local[") or context.master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def new_folder(spark: SparkSession, prefix: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; the plan starts anew."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
