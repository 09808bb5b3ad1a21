"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group and stay together. Groups that weigh more than a thousandth of a shard are items of their own,
fewer than 1000 * shards by that definition; all others fall, by their hash, into `buckets` items. Differencing runs on
these items alone, so the driver sees at most 1000 * shards + buckets numbers at any input size, and balance is
that of the items: the spread left after combining thousands of nearly equal ones.

Defined results: null and empty texts are one group of size 1 a row; repeated rows each get a slot; a null id is an id
like any other; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.llm.common import cut


def differencing(items: Iterable[tuple[Hashable, int]], ways: int) -> dict[Hashable, int]:
    """Item -> part. Partial partitions are `ways` (sum, members) in falling order of sum; the two with the largest
    spread are combined, the largest part of one with the smallest of the other, until one is left."""
    heap = []
    for n, (item, weight) in enumerate(sorted(items, key=lambda x: (-x[1], str(x[0])))):
        parts = [(weight, [item])] + [(0, [])] * (ways - 1)
        heap.append((-weight, n, parts))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = []
        for (x, left), (y, right) in zip(a, reversed(b), strict=True):
            small, large = sorted((left, right), key=len)
            parts.append((x + y, large + small if len(large) < 64 else (large.extend(small) or large)))
        parts.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
        n += 1
    return {item: part for part, (_, members) in enumerate(heap[0][2] if heap else []) for item in members}


def shard(docs: DataFrame, shards: int = 8, buckets: int = 4096, rows_per_unit: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): slots count up from 0 without a gap in each shard.

    Slots are dealt by units of about `rows_per_unit` rows: a unit's rows are numbered on their own, and the units'
    counts give each its start, so that no shard is ever in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("grp"),
            F.pmod(F.monotonically_increasing_id(), F.lit(61)).cast("int").alias("salt"),
        )
    )
    groups = cut(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    limit = total["bytes"] // (1000 * shards)
    bucket = F.pmod(F.conv(F.substring("grp", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("string")
    item = F.when(F.col("bytes") > limit, F.col("grp")).otherwise(bucket)
    part_of = differencing([(r["item"], r["bytes"]) for r in groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()], shards)
    spark = docs.sparkSession
    table = spark.createDataFrame(list(part_of.items()), "item string, shard int").coalesce(1)
    alone = F.broadcast(table.where(F.length("item") == 32).select(F.col("item").alias("grp"), F.col("shard").alias("own_shard")))
    pooled = F.broadcast(table.where(F.length("item") < 32).select(F.col("item").alias("pool"), F.col("shard").alias("pool_shard")))
    units = int(total["n"]) // (rows_per_unit * shards) + 1
    placed = (
        rows.join(alone, "grp", "left")
        .withColumn("pool", bucket)
        .join(pooled, "pool", "left")
        .select("id", "size", "text_crc32", "grp", F.coalesce("own_shard", "pool_shard").alias("shard"), F.pmod(F.xxhash64("id", "grp", "salt"), F.lit(units)).alias("unit"))
    )
    before = W.partitionBy("shard").orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "unit").agg(F.count(F.lit(1)).alias("n")).select("shard", "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "unit").orderBy("id", "grp")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(starts, ["shard", "unit"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))
    )
