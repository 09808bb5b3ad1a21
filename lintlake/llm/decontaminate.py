r"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

A window is `span` consecutive words of a benchmark item (all words of a shorter one). It occurs in a document only if all its shingles
do, so one necessary shingle is enough to find it: the rarest over all documents.

shingle_counts()  how often each benchmark shingle occurs in the documents (one pass over the texts).
anchors()         each distinct window with its rarest shingle and that shingle's place in it.
candidates()      places of documents where an anchor's shingle occurs, with the few words round it (one pass over the texts).
occurrences()     candidates joined with windows by shingle, kept if the window fits by place and length and all words are equal.
contamination()   one row per document: words, words hit, items found.

Both passes test a shingle's hash against a bitmap of BITS bits first (512 KB at any size of benchmark or corpus), so what is shuffled
are the documents' shingles that the benchmark has, and chance hits. Spark splits a shingle that is met in many documents between
tasks (adaptive skew join): nothing is grouped by it.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lowered, so other capitals stay as they are.

Defined results: null and wordless documents have 0 words and no hit; null and wordless items have no window; items are told apart
by id, a null id's windows hit but name no item; repeated documents keep one row each, repeated items count once; empty tables give an
empty result or no hits; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.llm.common import cut

SPAN = 10
SHINGLE = 3
BITS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words as they stand; lowered() makes them words of the definition. Lowering some words is cheaper than lowering every text."""
    parts = F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def lowered(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(text, UPPER, LOWER)


def _shingle(words: Column, n_words: Column, at: Column, n: int) -> Column:
    """Hash of n words from place `at` (from 0), all capitals lowered: windows that are equal have equal hashes. Null beyond the end."""
    return F.when((at >= 0) & (at + n <= n_words), F.xxhash64(*[F.lower(F.get(words, at + j)) for j in range(n)]))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(item, gram, length): every window of every item, words joined by spaces."""
    rows = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - span, F.lit(0)))
    each = rows.select("item", "words", F.explode(starts).alias("start"))
    return each.select("item", lowered(F.array_join(F.slice("words", F.col("start") + 1, F.lit(span)), " ")).alias("gram"), F.least(F.size("words"), F.lit(span)).alias("length")).distinct()


def shingles(grams: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(gram, length, n, offset, h): the shingles of each distinct window; those with fewer than n words are one shingle."""
    rows = grams.select("gram", "length").distinct().select("gram", "length", F.split("gram", " ").alias("words"), F.least("length", F.lit(n)).alias("n"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("n"))).alias("offset"))
    hashed = F.coalesce(*[F.when(F.col("n") == k, _shingle(F.col("words"), F.col("length"), F.col("offset"), k)) for k in range(1, n + 1)])
    return each.select("gram", "length", "n", "offset", hashed.alias("h"))


def bitmap(hashes: DataFrame) -> Column:
    """BITS bits as an array of longs, read once as a scalar: the size is fixed, whatever the benchmark's."""
    slot = F.pmod("h", F.lit(BITS))
    set_bits = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) & 63 as int))")).alias("bits"))
    full = hashes.sparkSession.range(BITS >> 6).withColumnRenamed("id", "word").join(set_bits, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    packed = full.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return cut(packed.select(F.transform("all", lambda s: s["bits"]).alias("map"))).scalar()


def _known(h: Column, bits: Column) -> Column:
    word = F.get(bits, F.shiftright(F.pmod(h, F.lit(BITS)), 6).cast("int"))
    return F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1


def _lengths(grams: DataFrame) -> list[int]:
    """The shingle lengths in use, SHINGLE numbers at most."""
    return sorted(r["n"] for r in grams.select("n").distinct().collect())


def _places(docs: DataFrame, grams: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """(kept, words, n_words, at, h): the places of all documents where a shingle's bit is set, and place -1 of each document."""
    bits, lengths = bitmap(grams.select("h").distinct()), _lengths(grams) or [SHINGLE]
    rows = docs.select(*kept, words(F.col(text_col)).alias("words")).select("*", F.size("words").alias("n_words"))
    # outer: else Spark infers a filter that cuts every text into words once more
    each = rows.select("*", F.explode_outer(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("at"))
    hashes = F.array(*[_shingle(F.col("words"), F.col("n_words"), F.col("at"), n) for n in lengths])
    hashed = each.select("*", F.posexplode(hashes).alias("nth", "h"))  # a row each, so that no hash is computed twice
    return hashed.where(F.when(F.col("at") < 0, F.col("nth") == 0).otherwise(_known(F.col("h"), bits))).drop("nth")


def shingle_counts(docs: DataFrame, grams: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, seen): occurrences in all documents of the shingles that windows have; a few others share their bits."""
    return _places(docs, grams, text_col).where("at >= 0").groupBy("h").agg(F.count(F.lit(1)).alias("seen"))


def anchors(docs: DataFrame, grams: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, length, n, offset, h): each distinct window's rarest shingle; ties to the smaller hash, then to the first place."""
    each = cut(shingles(grams))
    counted = cut(each.join(shingle_counts(docs, each, text_col), "h", "left"))
    rarest = counted.groupBy("gram", "length", "n").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "offset")).alias("best"))
    return cut(rarest.select("gram", "length", "n", F.col("best.offset").alias("offset"), F.col("best.h").alias("h")))


def candidates(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Two kinds of rows. at = -1: one of each document, with row, id and n_words. Others: row, at, h, the words round the place and how many of them lie left of it."""
    each = _places(docs, chosen, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    place, left = F.col("at"), F.least(F.col("at"), F.lit(span - 1))
    return cut(
        each.select(
            "row",
            F.when(place < 0, F.col("id")).alias("id"),
            F.when(place < 0, F.col("n_words")).cast("long").alias("n_words"),
            "at",
            F.when(place >= 0, F.col("h")).alias("h"),
            F.when(place >= 0, F.slice("words", place - left + 1, F.lit(2 * span - 1))).alias("near"),
            F.when(place >= 0, left).alias("left"),
        )
    )


def occurrences(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, start, length, gram): every place where a window occurs."""
    met = found.where("at >= 0").select("row", "at", "h", "near", "left").join(chosen, "h").where("left >= offset AND size(near) - left + offset >= length")
    same = lowered(F.array_join(F.slice("near", F.col("left") - F.col("offset") + 1, F.col("length")), " ")) == F.col("gram")
    return met.where(same).select("row", (F.col("at") - F.col("offset")).alias("start"), "length", "gram").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id, n_words, n_hit, items): for every document its words, those inside any occurrence of a window, and the sorted ids of the items that these windows belong to."""
    every = cut(windows(items, item_col, item_text_col, span))
    chosen = anchors(docs, every, text_col)
    found = candidates(docs, chosen, id_col, text_col, span)
    hits = cut(occurrences(found, chosen))
    end = F.col("start") + F.col("length")
    before = W.partitionBy("row").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    covered = hits.select("row", "start", "length").distinct().select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", "gram").distinct().join(every.where("item IS NOT NULL").select("item", "gram"), "gram").select("row", F.col("item").cast("string").alias("item")).distinct()
    listed = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    known = found.where("at < 0").select("row", "id", "n_words").join(covered, "row", "left").join(listed, "row", "left")
    none = F.array().cast("array<string>")
    return known.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


#: The digests from all windows of all documents, in DuckDB.
CONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
p AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
hit AS (SELECT DISTINCT p.r, p.s, p.n, g.item_id FROM p JOIN g ON g.n = p.n AND array_to_string(p.w[p.s:p.s + p.n - 1], ' ') = g.gram),
c AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM (SELECT r, s, unnest(range(n)) AS k FROM hit) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
