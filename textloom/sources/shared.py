"""Tables written between the steps of a query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, where none may be set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    where = context._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return str(where.get())
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='textloom-')}")
    return str(context._jsc.sc().getCheckpointDir().get())


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: it is computed once, and a lost executor costs no rework."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
