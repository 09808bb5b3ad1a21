"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Every row gets a 48-bit hash of its id. Per source, words are summed by the leading bits of the hash; the bucket in
which the running sum passes the source's budget is refined by the next bits, twice, and its few remaining rows by
the whole hash. What comes out is one threshold per source, so a mix is a filter and nothing is sorted as a whole;
thresholds are nested: a larger budget keeps every row of a smaller one.

Defined results: null texts have size 0 and are never taken more than nothing; null sources form one source, last in
order; rows with one id share a hash and are taken together; a null id hashes as the empty string; an empty table gives
an empty result; columns besides id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.llm.common import WORD, cut, whole_row

HASH_BITS = 48
LEVEL_BITS = 10
LEVELS = 3


def _hash(row_id: Column) -> Column:
    digest = F.md5(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, h) of every row, in one pass over the text."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), _hash(F.col(id_col)).alias("h"))


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target): `share` of all words dealt out by weight, none above `most` times its source.

    Weights repeat over the sources in code point order, null last. Sources in order of cap / weight are capped as long as their
    part of what is left would exceed the cap; the others share the rest by weight.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    fill = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everywhere = W.partitionBy()
    return (
        each.withColumn("place", F.row_number().over(order))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("budget", F.sum("source_size").over(everywhere) * F.lit(share))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.sum("weight").over(rest) <= F.col("weight") * F.col("left"))
        .withColumn("open_budget", F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everywhere), F.lit(0.0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everywhere))
        .select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("open_budget") / F.col("open_weight")).alias("target"))
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): rows of the source with h < threshold hold about `rem` words.

    budgets: (source, rem). A row counts in if that brings the sum nearer to rem (or as near).
    """
    edge = cut(budgets.where("rem > 0").select("source", "rem", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("prefix")))
    running = W.partitionBy("source").orderBy("bucket")

    def inside(level: int) -> DataFrame:
        high = F.shiftright("h", HASH_BITS - LEVEL_BITS * level)
        return sizes.alias("s").join(edge.withColumnRenamed("source", "of").alias("e"), F.col("s.source").eqNullSafe(F.col("e.of")) & (high == F.col("e.prefix"))).select("source", "size", "h", "rem", "base", "prefix")

    for level in range(LEVELS):
        summed = inside(level).groupBy("source", F.shiftright("h", HASH_BITS - LEVEL_BITS * (level + 1)).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rem").alias("rem"), F.first("base").alias("base"))
        after = summed.withColumn("after", F.col("base") + F.sum("words").over(running))
        passed = after.where("after > rem").withColumn("nth", F.row_number().over(running)).where("nth = 1")
        edge = cut(passed.select("source", "rem", (F.col("after") - F.col("words")).alias("base"), F.col("bucket").alias("prefix")))
    units = inside(LEVELS).groupBy("source", F.col("h").alias("bucket")).agg(F.sum("size").alias("words"), F.first("rem").alias("rem"), F.first("base").alias("base"), F.first("prefix").alias("prefix"))
    after = units.withColumn("after", F.col("base") + F.sum("words").over(running))
    upper = F.shiftleft(F.max("prefix") + 1, HASH_BITS - LEVEL_BITS * LEVELS)
    out = F.col("after") * 2 - F.col("words") > F.col("rem") * 2
    return after.groupBy("source").agg(F.coalesce(F.min(F.when(out, F.col("bucket"))), upper).alias("threshold"))


def plan(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target, whole, threshold): every row of a source goes in `whole` times, once more if its h is below the threshold.

    A source whose target is several times its size is taken whole that often; the threshold takes the remainder.
    """
    wanted = cut(
        targets(sizes, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rem", F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    )
    found = thresholds(sizes, wanted.select("source", "rem"))
    # a source without a boundary keeps everything if something is left to take, else nothing more
    every = F.when(F.col("rem") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))
    return cut(
        wanted.alias("w")
        .join(found.withColumnRenamed("source", "of").alias("f"), F.col("w.source").eqNullSafe(F.col("f.of")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("threshold", every).alias("threshold"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often each row goes into the mix, 0 to `most` times."""
    sizes = cut(sized(docs, id_col, text_col, source_col))
    chosen = plan(sizes, weights, share, most).withColumnRenamed("source", "of")
    return (
        sizes.alias("s")
        .join(chosen.alias("p"), F.col("s.source").eqNullSafe(F.col("p.of")))
        .select(F.col("s.id").alias(id_col), "source", "size", "source_size", "target", (F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")).alias("copies"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. The text stays where it is; only the plan is joined."""
    chosen = plan(cut(sized(docs, id_col, text_col, source_col)), weights, share, most)
    chosen = chosen.select(F.col("source").alias("__of"), F.col("whole").alias("__whole"), F.col("threshold").alias("__threshold"))
    taken = F.col("__whole") + (_hash(F.col(id_col)) < F.col("__threshold")).cast("long")
    return docs.join(chosen, F.col(source_col).eqNullSafe(F.col("__of"))).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), taken.cast("int")))).select(*whole_row(docs))


#: The same mix in DuckDB: running sums over the whole hash order in place of histograms.
MIX_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
e AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM e),
c AS (SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM p),
l AS (SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c),
k AS (SELECT *, cap * rest <= weight * left_over AS capped FROM l),
o AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS open_budget, sum(weight) FILTER (WHERE NOT capped) OVER () AS open_weight FROM k),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * open_budget / open_weight END AS target FROM o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS whole FROM t),
d AS (SELECT s.*, q.source_size, q.target, q.whole, CASE WHEN whole < 2 THEN target - whole * q.source_size ELSE 0 END AS rem,
             CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS after_sum,
             CAST(sum(size) OVER (PARTITION BY s.source, h) AS DOUBLE) AS own
      FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rem > 0 AND after_sum * 2 - own <= rem * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d
"""
