"""Cuts of a plan's lineage that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def durable_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only a session on one machine may go without it: there one
    is made up, as in tests. On a cluster each executor would write to a disk of its own, so that is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def forget(*tables: DataFrame) -> None:
    """Deletes tables of durable that no plan reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.durable_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df written as a table in the folder that all executors share, and read again. What is planned on top starts
    from a file scan, so a loop's rounds do not get slower to plan. Then the tables `spent` are deleted."""
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    forget(*spent)
    return out


def counted(df: DataFrame, number: Column, spent: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, int]:
    """durable, and an aggregate of its rows that is had while they are written, without a job of its own. (Stages
    that run twice may count rows twice, so only whether a count is zero is to be relied upon.)"""
    seen = Observation()
    out = durable(df.observe(seen, number.alias("n")), spent)
    return out, seen.get["n"]
