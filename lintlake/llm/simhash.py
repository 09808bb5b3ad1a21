"""SimHash near-duplicates, linked by a generalised pigeonhole search.

fingerprints()   64-bit SimHash of word shingles (Arrow batches, one text at a time, whole texts).
link()           pairs of distinct fingerprints at `distance` or fewer bits: bits are grouped into partitions
                 so that correlated bits stand together, each partition gets its own threshold by dynamic
                 programming over estimated candidate counts, fingerprints probe the partitions' values and
                 candidates are verified. Buckets with more than `bucket` values are not paired: their members
                 go through one key per midpoint, which finds the same links with a row count linear in members
                 (two values are within 2 bits exactly if some value is within 1 bit of both).
components()     connected components of an edge table by alternating large-star and small-star joins.
near_duplicates()  one row per document: fingerprint and the smallest id that its links reach.

Defined results: null, empty and white-space texts have fingerprint zero and link like any other value;
fewer words than a shingle make one shingle; repeated rows keep one result row each; a null id is kept and
never names a component unless all ids of the component are null; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import cut, text_batches, whole_row

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash as an unsigned integer: a bit is set if it is set in over half of the shingles' XXH64 values."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined, n = b" ".join(parts), len(parts)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = slice(at, at + (1 << 16))
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[part], ends[part], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42, out_col: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit column."""

    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out_col, of(F.col(text_col)))


# ---------------------------------------------------------------- plan of the pigeonhole search


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into `parts` groups of about equal width, correlated bits together.

    Each group starts with the free bit of the strongest remaining correlation and takes, one by one, the free
    bit that correlates most with the group.
    """
    bits = ((sample.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & 1).astype(float)
    bits -= bits.mean(0, keepdims=True) if len(sample) else 0
    norm = np.sqrt((bits**2).sum(0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9) if len(sample) else np.zeros((BITS, BITS))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group = [max(free, key=lambda b: corr[b, free].max())]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: corr[b, group].sum()))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def estimated_cost(sample: np.ndarray, group: list[int], most: int, rows: int) -> list[float]:
    """Rows that a partition adds at threshold -1, 0, ..., most: its probes and index, and the candidates they meet."""
    mask = np.uint64(sum(1 << b for b in group))
    values = sample[:2000].astype(np.uint64) & mask
    costs, near = [0.0], np.zeros(most + 1)
    if len(values) > 1:
        diff = np.bitwise_count(values[:, None] ^ values[None, :])
        near = np.array([((diff <= t).sum() - len(values)) / (len(values) * (len(values) - 1)) for t in range(most + 1)])
    for t in range(most + 1):
        ball = sum(comb(len(group), j) for j in range(t + 1))
        chance = max(near[t], ball / 2 ** len(group))
        costs.append(rows * (ball + 1.0) + chance * rows * rows / 2)
    return costs


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Dynamic programming: thresholds (-1 skips a partition) that add up to `total` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for t, c in enumerate(cost, start=-1):
                key = spent + t
                if key not in step or value + c < step[key][0]:
                    step[key] = (value + c, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def search_plan(sample: np.ndarray, rows: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that takes part; by the pigeonhole principle thresholds of m partitions
    need only add up to distance - m + 1."""
    plans = []
    for parts in range(1, distance + 3):
        groups = group_bits(sample, parts)
        value, chosen = allocate([estimated_cost(sample, g, distance, rows) for g in groups], distance - parts + 1)
        plans.append((value, parts, [(g, t) for g, t in zip(groups, chosen, strict=False) if t >= 0]))
    return min(plans, key=lambda p: p[:2])[2]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _ball(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(bits, r)]


def link(values: DataFrame, distance: int = 2, bucket: int = 64, sample_rows: int = 20_000) -> DataFrame:
    """Edges (src, dst), src < dst, that connect the same values as all pairs within `distance` bits.

    values: one column fp, distinct. The plan is fitted on at most about `sample_rows` values (a hash sample);
    every value is indexed and probes. Pairs in small buckets are emitted as they are; members of larger ones are
    linked through shared midpoints, so that no group is paired with itself.
    """
    if distance % 2:
        raise ValueError("distance must be even: two values share a midpoint key exactly if they are that near")
    rows = values.count()
    keep = min(1.0, sample_rows / max(rows, 1))
    sample = values.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    fitted = np.array([r[0] for r in sample.limit(2 * sample_rows).collect()], np.int64).view(np.uint64)
    plan = search_plan(fitted, rows, distance)

    def entries(k: int, bits: list[int], radius: int):
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        masks = F.array(*[F.lit(m) for m in _ball(bits, radius)])
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("part"), own.bitwiseXOR(m).alias("key")))

    def keyed(radius_of) -> DataFrame:
        return values.select("fp", F.inline(F.concat(*[entries(k, bits, radius_of(t)) for k, (bits, t) in enumerate(plan)])))

    index = keyed(lambda t: 0)
    probes = keyed(lambda t: t).withColumnRenamed("fp", "probe")
    hot = cut(index.groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key"))
    pairs = (
        index.join(hot, ["part", "key"], "left_anti")
        .join(probes, ["part", "key"])
        .where((F.col("fp") != F.col("probe")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= distance))
        .select(F.least("fp", "probe").alias("src"), F.greatest("fp", "probe").alias("dst"))
        .distinct()
    )
    crowded = cut(probes.select("part", "key", F.col("probe").alias("fp")).join(hot, ["part", "key"], "left_semi").select("fp").distinct())
    around = F.array(*[F.lit(m) for m in _ball(list(range(BITS)), distance // 2)])
    mids = crowded.select("fp", F.explode(F.transform(around, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    heads = mids.groupBy("mid").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "src")
    stars = mids.join(heads, "mid").where(F.col("fp") != F.col("src")).select("src", F.col("fp").alias("dst"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without an edge have no row.

    Alternates large-star and small-star until the edges are stars; every round is written to the shared folder.
    """
    edges, seen = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(values: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of distinct fingerprints: root is the smallest one that links reach."""
    roots = components(link(values.select("fp"), distance))
    return values.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of docs: id, fp (signed), component_id (the smallest id reachable over links)."""
    known = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", words).select("id", "fp"))
    labelled = classes(cut(known.groupBy("fp").agg(F.min("id").alias("least_id"))), distance)
    named = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = cut(labelled.join(named, "root").select("fp", "component_id"))
    return known.join(placed, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (null last), then the smallest hash of its text.

    Rows are chosen by a number of their own: rows that share an id or have none are grouped by their texts like any others.
    """
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*whole_row(docs)).alias("doc"))
    known = cut(fingerprints(held, "text", words).select("row", "id", F.xxhash64("text").alias("hash"), "fp", "doc"))
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash", "row"))
    stay = classes(cut(known.groupBy("fp").agg(best.alias("best"))), distance).groupBy("root").agg(F.min("best").alias("best"))
    return known.join(cut(stay.select(F.col("best.row").alias("row"))), "row", "left_semi").select("doc.*")
