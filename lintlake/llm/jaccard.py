"""Near-duplicates by exact Jaccard similarity of word shingles; SimHash and MinHash propose, shingle sets decide.

mark()       docs with a row number and, of each text's set of shingle hashes, a digest, its size, its SimHash and one key per band.
linked()     edges between distinct sets whose similarity is at least `least`. Candidates come from two searches: SimHash fingerprints
             by the generalised pigeonhole search, and sets that share a MinHash band key. Buckets of up to `bucket` sets are paired.
             Members of larger ones meet two representatives first, the smallest set and one by its hash; then only members of different components are paired, and of
             these only those whose sizes and common shingles leave a similarity of `least` possible.
keep_one()   docs with one row of each component.

A shingle is its 64-bit XXH64 value. 32 bands of 5 values propose a pair of similarity 0.8 with probability 1 - 3e-6, and a more
similar one more surely; what is proposed is verified on whole sets with integers.

Defined results: null, empty and white-space texts have an empty set, and empty sets are equal; fewer words than a shingle make one
shingle; the row that stays is the one with the smallest id (null last), then the smallest hash of its text; rows without an id are
grouped like any others; an empty table gives an empty result; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import cut, text_batches, whole_row
from lintlake.llm.simhash import BITS, components, link

BANDS, ROWS = 32, 5
#: Longs in the bitmap of a set, for an upper bound of what two sets share.
LONGS = 16
_RNG = np.random.default_rng(11)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    import xxhash

    parts = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), 42)], np.uint64)
    joined, n = b" ".join(parts), len(parts)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed 64-bit key per band; an empty set has none."""
    import xxhash

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (FACTORS[:, None] * found[None, at : at + 512] + SHIFTS[:, None]).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed integer."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def mark(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(row, set (digest, size, fp, bands), doc): doc holds the row as it came, so that no name of its columns can clash."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("digest string, size long, fp long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            sets = [shingles(t, words) for t in texts]
            yield pd.DataFrame({"digest": [xxhash.xxh128_hexdigest(s.tobytes()) for s in sets], "size": [len(s) for s in sets], "fp": [set_fingerprint(s) for s in sets], "bands": [band_keys(s) for s in sets]})

    return docs.select(F.monotonically_increasing_id().alias("row"), of(F.col(text_col)).alias("set"), F.struct(*whole_row(docs)).alias("doc"))


def similar(pairs: DataFrame, sets: DataFrame, least: float, salts: int = 4) -> DataFrame:
    """The pairs (src, dst) whose sets are similar enough. sets: node, hashes. salts: copies of each src's set, as few stand in many pairs."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(salts)))
    left = sets.join(pairs.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("src"), F.col("hashes").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    both = salted.join(sets.select(F.col("node").alias("dst"), F.col("hashes").alias("b")).hint("merge"), "dst").join(left.hint("merge"), ["src", "salt"])
    return cut(both.where(_possible(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"), least)).select("src", "dst"))


def _possible(shared: Column, a: Column, b: Column, least: float) -> Column:
    """Whether sets of sizes a and b that share (at most) so many members (can) have a Jaccard similarity of `least`, in whole percents."""
    percent = round(100 * least)
    return (100 + percent) * shared >= percent * (a + b)


def narrowed(members: DataFrame, sets: DataFrame, least: float, rounds: int = 2) -> DataFrame:
    """members (key, node, size, root) with `shared`, `bits` and `spare`, without those that can have no similar partner of another root.

    A partner of another root shares at most the shingles that stand under two roots or more (`shared`), and is no smaller than the
    smallest member of another root in the same bucket. Leaving members out lowers these counts, hence the rounds; their number
    decides how many pairs are verified, not what is found.
    """
    for _ in range(rounds):
        inside = members.select("node", "root").distinct()
        rows = cut(sets.join(inside, "node").select("node", "root", F.explode("hashes").alias("hash")))
        across = rows.groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("hash")
        slot = F.pmod("hash", F.lit(64 * LONGS)).cast("int")
        marked = rows.join(across, "hash", "left_semi").select("node", F.floor(slot / 64).cast("int").alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), slot % 64).alias("bit"))
        bits = F.array(*[F.bit_or(F.when(F.col("place") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))) for k in range(LONGS)])
        shared = marked.groupBy("node").agg(F.count(F.lit(1)).alias("shared"), bits.alias("bits"))
        shared = shared.withColumn("spare", F.col("shared") - F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b)))
        counted = cut(members.drop("shared", "bits", "spare").join(shared, "node"))
        by_root = counted.groupBy("key", "root").agg(F.min("size").alias("size"))
        first = by_root.groupBy("key").agg(F.min(F.struct("size", "root")).alias("first"))
        second = by_root.join(first, "key").where("root <> first.root").groupBy("key", "first").agg(F.min("size").alias("second"))
        other = F.when(F.col("root") == F.col("first.root"), F.col("second")).otherwise(F.col("first.size"))
        members = cut(counted.join(second, "key").where(_possible(F.col("shared"), F.col("size"), other, least)).select("key", "node", "size", "root", "shared", "bits", "spare"))
    return members


def linked(sets: DataFrame, texts: DataFrame, words: int = 5, least: float = 0.8, bucket: int = 8, block: int = 1024) -> DataFrame:
    """Edges (src, dst) that connect the same sets as all proposed pairs of at least that similarity. sets: node, size, fp, bands; texts: node, text."""
    heads = cut(sets.groupBy("fp").agg(F.min("node").alias("head")))
    near = link(heads.select("fp"))
    by_bits = (
        near.join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src")
        .join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        .union(sets.join(heads, "fp").where("node <> head").select(F.col("head").alias("src"), F.col("node").alias("dst")))
    )
    index = cut(sets.select("node", "size", F.explode("bands").alias("key")))
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = cut(index.hint("merge").join(shared, "key"))
    cold, hot = placed.where(F.col("n") <= bucket), placed.where(F.col("n") > bucket)
    by_size, by_hash = F.struct("size", "node"), F.struct(F.xxhash64("node"), "node", "size")  # the hash is alike in all buckets of a group
    ends = hot.groupBy("key").agg(*[F.struct(of["node"].alias("node"), of["size"].alias("size")).alias(f"c{k}") for k, of in enumerate((F.min(by_size), F.min(by_hash)))])
    leads = cut(ends.select("key", F.explode(F.array("c0", "c1")).alias("lead")).select("key", F.col("lead.node").alias("src"), F.col("lead.size").alias("sa")))
    stars = hot.join(leads, "key").where((F.col("src") != F.col("node")) & _possible(F.least("sa", "size"), F.col("sa"), F.col("size"), least)).select("src", F.col("node").alias("dst"))
    pairs = cut(paired(cold, least).select("src", "dst").union(by_bits).union(stars).distinct())

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([shingles(t, words).view(np.int64) for t in some], dtype=object)

    asked = pairs.select(F.explode(F.array("src", "dst")).alias("node")).union(hot.select("node")).distinct()
    whole = cut(texts.hint("merge").join(asked, "node", "left_semi").select("node", of(F.col("text")).alias("hashes")))
    edges = similar(pairs, whole, least)
    if hot.isEmpty():
        return edges
    rooted = cut(hot.join(components(edges), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    left = narrowed(cut(rooted.join(mixed, "key", "left_semi")), whole, least)
    return edges.union(similar(cut(across_roots(left, least, block)), whole, least))


def paired(members: DataFrame, least: float) -> DataFrame:
    """Pairs (src, dst) of a bucket, in the order of their numbers, whose sizes do not rule them out."""
    a = members.select("key", F.col("node").alias("src"), F.col("size").alias("sa"))
    b = members.select("key", F.col("node").alias("dst"), F.col("size").alias("sb"))
    return a.join(b, "key").where((F.col("src") < F.col("dst")) & _possible(F.least("sa", "sb"), F.col("sa"), F.col("sb"), least))


def across_roots(members: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs (src, dst) of members of one bucket but different roots that may be similar, each once: at the first key that both have.

    Two sets share at most as many members as bits of their bitmaps, and what either has more members than bits. A bucket is dealt into blocks of about `block` members, and each two blocks meet in a row group of their own, so that no bucket
    is one task's work.
    """
    keys = members.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # a key a band at most
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = cut(members.join(keys, "node").join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    everyone = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda names, own, other: dealt.select("key", F.col("own").alias(own), everyone.alias(other), *[F.col(c).alias(f"{c}_{names}") for c in ("node", "size", "root", "shared", "bits", "spare", "keys")])
    met = side("a", "at", "with").join(side("b", "with", "at"), ["key", "at", "with"])
    fits = _possible(F.least("shared_a", "shared_b", "size_a", "size_b"), F.col("size_a"), F.col("size_b"), least)
    once = F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == F.col("key")
    both = F.aggregate(F.zip_with("bits_a", "bits_b", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b)
    close = _possible(both + F.least("spare_a", "spare_b"), F.col("size_a"), F.col("size_b"), least)
    return met.where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & fits & once & close).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bucket: int = 8) -> DataFrame:
    """docs with one row of each component of similar texts."""
    marked = cut(mark(docs, text_col, words))
    doc_id, text = F.col("doc").getField(id_col), F.col("doc").getField(text_col)
    best = F.min(F.struct(doc_id.isNull().alias("unnamed"), doc_id.alias("id"), F.xxhash64(text).alias("hash"), F.col("row").alias("row")))
    sets = cut(marked.groupBy("set.digest").agg(best.alias("best"), F.first("set.size").alias("size"), F.first("set.fp").alias("fp"), F.first("set.bands").alias("bands")).withColumn("node", F.col("best.row")).drop("digest"))
    roots = components(linked(sets.select("node", "size", "fp", "bands"), marked.select(F.col("row").alias("node"), text.alias("text")), words, least, bucket))
    stay = sets.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return marked.hint("merge").join(cut(stay), "row", "left_semi").select("doc.*")
