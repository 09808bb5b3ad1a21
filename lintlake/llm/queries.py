"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import audio, chat, decontaminate, html_extract, langid, mixing, packing, quality_crf, repair, sharding, simhash, vptree, whitening
from lintlake.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    bank = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, bank).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.store(_table(spark, sf_dir, "documents"), F.col("text").cast("binary"))
    read = audio.analyse(media)
    spans = F.array_join(F.transform("audio.segments", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("audio.payload").cast("long").alias("payload_bytes"),
        F.sha2("audio.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("audio.payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("audio.frames").cast("string"), F.lit(";segments="), F.size("audio.segments").cast("string"), F.lit(";spans="), F.sha2(spans, 256), F.lit(";mel="), F.sha2("audio.tensors", 256)).alias("feature"),
    )


def op4_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = quality_crf.fit(docs.where(~F.col("held_out")), _table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(control).alias("text"))
    shown = chat.conversations(chat.threads(rows.unionByName(extra)), most=1)
    turns = F.array_join(F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = shown.select("tree", "formatted", chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size(chat.parse(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"))
    return read.select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vptree.neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, slack=1.0)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), k=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_prefix_filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that operator 13 is asked to repair, by crc32 of `conv_id:turn`."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    changed = rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def op13_dijkstra_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, turns = repair.repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", repair.conversation_key("conv_id"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = every.join(report, "conv", "left").join(repair.digests(turns), "conv", "left")
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.MIX_SQL, "op8_reply_trees": chat.CHAT_SQL, "op9_vantage_point_trees": vptree.NEIGHBOURS_SQL, "op12_prefix_filtered_join": decontaminate.CONTAMINATION_SQL, "op13_dijkstra_repair": repair.REPAIR_SQL}
