"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only a local session may make one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="palisade-checkpoint-"))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder that all executors share."""
    _folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the reliable checkpoint folder and read back from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the checkpoint folder: no lineage, and later reads take only the columns they need."""
    path = fresh_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
