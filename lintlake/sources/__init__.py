"""Readers of source trees and text logs into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import normalize_path

#: Folders that are not read (fixed values).
DENIED = ("node_modules", ".git", "dist", ".next", "build", "coverage")


def scan_corpus(spark: SparkSession, root: str, extensions: Sequence[str] = (".ts", ".tsx", ".js", ".jsx"), denied: Sequence[str] = DENIED, max_bytes: int = 1_000_000) -> DataFrame:
    """Files below a root folder of repositories: repo (the first folder), path within it, content, size.

    Large files and denied folders are dropped by path and length before their content is decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    kept = files.select(inside.alias("inside"), "length", "content").where(F.col("length") <= max_bytes)
    folders = F.split("inside", "/")
    kept = kept.where(~F.exists(folders, lambda d: d.isin(*denied)) & F.lower(F.col("inside")).rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    repo = F.when(F.size(folders) > 1, folders[0]).otherwise("")
    return kept.select(repo.alias("repo"), normalize_path(F.array_join(F.slice(folders, F.when(F.size(folders) > 1, 2).otherwise(1), 1000), "/")).alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def parse_blame(lines: DataFrame) -> DataFrame:
    """Blamed lines of porcelain output: repo, path, line, commit_id. lines: repo, path, pos, text.

    A header is a commit id and line numbers; it holds for the next line that starts with a tab.
    """
    head = F.regexp_extract("text", r"^([0-9a-f]+) \d+ (\d+)", 0) != ""
    upto = W.partitionBy("repo", "path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    filled = lines.withColumn("head", F.last(F.when(head, F.col("text")), ignorenulls=True).over(upto))
    parts = F.split("head", " ")
    return filled.where(F.col("text").startswith("\t")).select("repo", "path", parts[2].cast("int").alias("line"), parts[0].alias("commit_id"))


def parse_commit_log(lines: DataFrame) -> DataFrame:
    """Changes of a commit log: repo, commit_id, author, file, added, deleted. lines: repo, pos, text.

    A header is COMMIT|id|author; the rows below it have added, deleted and file, parted by tabs.
    """
    upto = W.partitionBy("repo").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    is_head = F.col("text").startswith("COMMIT|")
    filled = lines.withColumn("head", F.last(F.when(is_head, F.col("text")), ignorenulls=True).over(upto))
    head, parts = F.split("head", r"\|"), F.split("text", "\t")
    return filled.where(~is_head & (F.size(parts) >= 3)).select("repo", head[1].alias("commit_id"), head[2].alias("author"), parts[2].alias("file"), F.coalesce(parts[0].try_cast("long"), F.lit(0)).alias("added"), F.coalesce(parts[1].try_cast("long"), F.lit(0)).alias("deleted"))
