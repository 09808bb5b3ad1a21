"""Tables between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all executors share. Where that is unset, a folder of this process in local mode; an
    error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lintlake-{uuid.uuid4().hex}"


def deal(df: DataFrame, rows: int, *keys: str, each: int = 1 << 15) -> DataFrame:
    """df dealt out by keys, so many of its rows (or of those that it comes from) to a task on average: what a task sorts does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def settle(df: DataFrame) -> DataFrame:
    """Write df and read it again: lineage ends there."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
