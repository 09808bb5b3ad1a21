"""Nearest neighbours by cosine with a vantage-point tree per shard.

build()   deals the vectors to shards by a hash of the id and builds a tree of the shard's distinct unit vectors, one
            binary row per shard. Equal vectors share an entry that keeps their `keep` smallest ids.
search()  deals the queries into blocks, meets every block with every shard, and merges the shards' best. A task holds one
            tree at a time and reads it once for a run of blocks.
            A query first walks to its own leaf, then visits every node whose distance bound is below slack * (its k-th best
            distance so far): slack 1 loses nothing, smaller values prune more than the triangle inequality allows.

Distances are Euclidean between unit vectors, which order like cosines. The score is the cosine of the original vectors in
double precision, with products added in component order.

Defined results: vectors that are null, empty, zero, of another dimension than the index's most frequent one, or hold null or
non-finite components take no part, neither as query nor as candidate; null ids take no part; rows that repeat id and vector are one
row; rows of one id with different vectors are candidates of their own, so the id can be found twice, but never by a query of that id,
which asks with each of its vectors and gets the best of all; ties go to the smaller id; fewer candidates than k give fewer rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.llm.common import cut

LEAF = 64


def margin(width: int) -> float:
    """More than what rounding adds to the difference of two distances of unit vectors: 2 - 2ab is off by (4 width + 12) units in the last place at most."""
    return 2 * float(np.sqrt((4 * width + 12) * np.finfo(float).eps / 2))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v an array of doubles, for vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; sums run in component order, like a fold. Powers of two bring each row to size 1 first, which rounds nothing."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))
    dot, aa, bb = (np.add.accumulate(x * y, axis=1)[:, -1] for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class VpTree:
    """Arrays of nodes in depth-first order. Inner nodes have a vantage point and the distance range of either side."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, own = np.unique(vectors, axis=0, return_inverse=True)
        own = own.ravel()
        by = np.lexsort((ids, own))
        first = np.searchsorted(own[by], np.arange(len(self.vectors)))
        self.ids = [np.unique(ids[by[a:b]])[:keep] for a, b in zip(first, [*first[1:], len(by)], strict=True)]
        self.first = np.array([i[0] for i in self.ids])
        self.single = np.array([len(i) == 1 for i in self.ids])
        self.unit = _unit(self.vectors)
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(self.vectors)), np.random.default_rng(seed))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "unit"}  # half the bytes; made again where the tree is read

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.unit = _unit(self.vectors)

    def _grow(self, members: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        if len(members) <= LEAF:
            self.nodes.append((members,))
            return at
        self.nodes.append(())
        point = int(rng.choice(members))
        d = _distances(self.unit[[point]], self.unit[members])[0]
        near = np.zeros(len(members), bool)
        near[np.argsort(d, kind="stable")[: len(members) // 2]] = True  # halves, whatever the ties
        sides = []
        for side in (near, ~near):
            sides.append((self._grow(members[side], rng), d[side].min(), d[side].max()))
        self.nodes[at] = (point, *sides[0], *sides[1])
        return at

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int, slack: float) -> list[list[tuple[float, int]]]:
        """For each query its k best (score, id), best first; an entry's own id is no candidate."""
        n, unit, slip = len(ids), _unit(vectors), margin(vectors.shape[1])
        best: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
        reach = np.full(n, np.inf)  # distance of the k-th best

        def leaf(members: np.ndarray, who: np.ndarray) -> None:
            d = _distances(unit[who], self.unit[members])
            limit = reach[who]
            own, fresh = self.first[members], np.zeros(len(members), bool)
            fresh[np.unique(own, return_index=True)[1]] = True
            if len(members) >= k:  # entries that are sure to be candidates of their own bound what is scored
                sure = (fresh & self.single[members])[None, :] & (own[None, :] != ids[who, None])
                limit = np.minimum(limit, np.partition(np.where(sure, d, np.inf), k - 1, 1)[:, k - 1])
            # rounding of d is below the margin: whatever may tie with the k-th best is ranked by its exact score and id
            row, col = np.nonzero(d <= limit[:, None] + slip)
            for at in range(0, len(row), 8192):
                q, e = who[row[at : at + 8192]], members[col[at : at + 8192]]
                for x, m, score in zip(q.tolist(), e.tolist(), cosine(vectors[q], self.vectors[e]).tolist(), strict=True):
                    best[x].extend((score, int(i), m) for i in self.ids[m] if i != ids[x])
                for x in np.unique(q).tolist():
                    best[x] = sorted(set(best[x]), key=lambda found: (-found[0], found[1]))[:k]
                    if len(best[x]) == k:
                        reach[x] = np.sqrt(max(2 - 2 * best[x][-1][0], 0))

        def home(at: int, who: np.ndarray) -> None:
            if not len(who):
                return
            node = self.nodes[at]
            if len(node) == 1:
                leaf(node[0], who)
                return
            point, near, _, near_to, far, far_from, _ = node
            d = _distances(unit[who], self.unit[[point]])[:, 0]
            inside = d <= (near_to + far_from) / 2
            home(near, who[inside])
            home(far, who[~inside])

        def visit(at: int, who: np.ndarray) -> None:
            if not len(who):
                return
            node = self.nodes[at]
            if len(node) == 1:
                leaf(node[0], who)
                return
            point, near, near_from, near_to, far, far_from, far_to = node
            d = _distances(unit[who], self.unit[[point]])[:, 0]
            for child, low, high in ((near, near_from, near_to), (far, far_from, far_to)):
                bound = np.maximum(np.maximum(low - d, d - high), 0)
                visit(child, who[bound <= slack * reach[who] + slip])

        everyone = np.arange(n)
        home(0, everyone)
        visit(0, everyone)
        return [[(score, i) for score, i, _ in found] for found in best]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build(vectors: DataFrame, keep: int, shards: int) -> DataFrame:
    """(shard, tree): vectors has id and v; equal vectors spread over the shards like any others."""

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        made = VpTree(rows["id"].to_numpy(), np.array(rows["v"].tolist()), keep)
        return pd.DataFrame({"shard": rows["shard"][:1], "tree": [pickle.dumps(made)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(tree, "shard int, tree binary")


def search(index: DataFrame, queries: DataFrame, shards: int, k: int = 5, slack: float = 1.0, block_rows: int = 2048, blocks_per_tree: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score). queries has id and v; every block of them meets every shard once.

    A tree is sent once for each run of blocks, ahead of them, and the task keeps it while they pass by.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block_rows))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))  # about block_rows each
    run = F.floor(F.col("block") / blocks_per_tree).cast("int")
    passing = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), run.alias("run"), "block", F.lit(None).cast("binary").alias("tree"), "queries")
    runs = F.sequence(F.lit(0), F.lit((blocks - 1) // blocks_per_tree))
    ahead = index.select("shard", F.explode(runs).alias("run"), F.lit(-1).alias("block"), "tree", F.lit(None).cast(packed.schema["queries"].dataType).alias("queries"))
    met = ahead.unionByName(passing).repartition("shard", "run").sortWithinPartitions("shard", "run", "block")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tree = None, None
        for batch in batches:
            for shard, run, sent, rows in zip(batch["shard"], batch["run"], batch["tree"], batch["queries"], strict=True):
                if sent is not None:
                    held, tree = (shard, run), pickle.loads(sent)
                elif held == (shard, run):  # a shard that no vector fell into has no tree
                    ids = np.array([r["id"] for r in rows])
                    found = tree.nearest(ids, np.array([list(r["v"]) for r in rows]), k, slack)
                    yield pd.DataFrame([(q, i, s) for q, best in zip(ids, found, strict=True) for s, i in best], columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row holds a whole tree
    try:
        best = cut(met.select("shard", "run", "tree", "queries").mapInPandas(look, "query_id long, vec_id long, score double"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, slack: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_shard: int = 8192) -> DataFrame:
    """The k nearest rows of vectors for each row of queries; shards hold about `rows_per_shard` rows at any size."""
    rows = cut(usable(vectors, id_col, vector_col).distinct())
    asked = usable(queries, id_col, vector_col).distinct()
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if width is not None:
        rows, asked = rows.where(F.size("v") == width["n"]), asked.where(F.size("v") == width["n"])
    shards = max(1, -(-rows.count() // rows_per_shard))
    return search(cut(build(rows, k + 1, shards)), cut(asked), shards, k, slack)


#: All pairs of queries and candidates in DuckDB, sums in component order.
NEIGHBOURS_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
