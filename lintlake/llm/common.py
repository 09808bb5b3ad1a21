"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a folder of this process in local mode; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lintlake-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, nothing is computed twice."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame) -> list[Column]:
    """All columns of docs, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the rows whose crc32(id as text) leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_batches(spark: SparkSession, rows: int = 256, size: int = 32 << 20) -> None:
    """Let Arrow batches hold few rows and bytes: whole texts can be long, and a worker holds a batch or two at once.

    Session settings, read when a plan is made; they only bound memory and change no result. A longer text is a batch of its own.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256, size: int = 32 << 20) -> Iterator[None]:
    """text_batches() for what runs inside; the session's settings return afterwards."""
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    text_batches(spark, rows, size)
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
